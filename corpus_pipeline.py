"""A corpus from documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorra.llm import cotrain, mixing, packing, simhash, suffix_dedup, tokens
from quorra.llm.common import file_count, release, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    Nulls in any column are features of their own; rows that repeat are judged alike; without labels of both classes every
    document stays. An empty table gives an empty one; columns besides COLUMNS are left out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotrain.classify(docs, labels).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of texts whose five-word shingles are 0.8 similar.

    Null doc_ids come last, null and empty texts are one class, rows that repeat id and text are one row. An empty
    table gives an empty one; columns besides COLUMNS are left out.
    """
    return simhash.near_dedup(docs).select(*COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words and the strings of 400 bytes that also start elsewhere.

    Documents with nothing left go; null and empty texts, and texts that lose nothing, stay as they are. Rows that repeat a
    text lose all of it that is long enough. An empty table gives an empty one; columns besides COLUMNS are left out.
    """
    return suffix_dedup.deduped_text(docs, emptied=False, files=file_count(docs)).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row an epoch, the last one cut at the source's budget.

    A null source is a source; rows without words stay once; rows that repeat are taken one by one. An empty table gives
    an empty one; columns besides COLUMNS are left out.
    """
    return mixing.mixed_documents(docs, files=file_count(docs)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Null and empty texts are the end id alone; null and repeated doc_ids are documents of their own; other columns are
    left out. An empty table gives an empty one.
    """
    return packing.op7(docs, tokens.public("byte_bpe_50k.json"), file_count(docs))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the near-duplicate classes are not SQL; tests hold stages 2 to 5 against brute force, stage 1 against
#: held-out labels, and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written to the shared folder; what only a stage needed is removed after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        label = f"stage-{name.replace(' ', '-')}"
        docs = saved(stage(spark, docs, sf_dir), label)
        release(spark, (label,))
    return STAGES[-1][1](spark, docs, sf_dir)
