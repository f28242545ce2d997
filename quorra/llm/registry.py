"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quorra.llm import cotrain, huffman, langid, media, mixing, packing, quality_rules, simhash, suffix_dedup, tokens, warc


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark, sf_dir):
    return simhash.simhash_classes(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.op2(_table(spark, sf_dir, "documents"))


def op3_token_id_output(spark, sf_dir):
    return huffman.op3(_table(spark, sf_dir, "documents"), tokens.public("word_bpe_49k.json"))


def op4_source_mixing(spark, sf_dir):
    return mixing.op4(_table(spark, sf_dir, "documents"))


def op5_language_id(spark, sf_dir):
    return langid.op5(_table(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.op6(_table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.op7(_table(spark, sf_dir, "documents"), tokens.public("byte_bpe_50k.json"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.op8(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark, sf_dir):
    return cotrain.op9(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_media_columns(spark, sf_dir):
    return media.op10(_table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    made = (op1_simhash_near_dedup, op2_suffix_array_dedup, op3_token_id_output, op4_source_mixing, op5_language_id, op6_warc, op7_best_fit_packing, op8_quality_rules, op9_quality_classifier, op10_media_columns, pipeline)
    return {f.__name__: f for f in made}


def oracle_sql():
    """SQL where it can express an operator: the others hash by XXH64, tokenize, compress or learn."""
    return {"op2_suffix_array_dedup": suffix_dedup.OP2_SQL, "op4_source_mixing": mixing.OP4_SQL, "op6_warc": warc.OP6_SQL, "op8_quality_rules": quality_rules.OP8_SQL}
