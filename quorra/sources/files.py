"""Reading and writing: paired text files of assignments and weights, result datasets, dense text matrices."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): non-empty lines without comments numbered from 0 in file order.

    Lines are numbered within each block that a task reads, and each block's first number is the count of lines in
    the blocks before it, a row a block.
    """
    order = ["_metadata.file_path", "_metadata.file_block_start"]
    rows = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(value, '#')")
    rows = rows.select("value", F.struct(F.col(order[0]).alias("file"), F.col(order[1]).alias("start")).alias("block"), F.monotonically_increasing_id().alias("place"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    first = sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1
    return rows.withColumn("inside", inside).join(first, "block").select((F.col("first") + F.col("inside")).alias("line"), "value")


def load_assignments(spark: SparkSession, weights_path: str, assignments_path: str, zero_indexed: bool = False) -> DataFrame:
    """(sid, a, b, w): one weight and two parcels a line, paired by line number; unassigned lines and self-loops go."""
    w = _numbered(spark, weights_path).select("line", F.trim("value").cast("double").alias("w"))
    parts = F.split(F.trim("value"), r"[\s,]+")
    ab = _numbered(spark, assignments_path).select("line", parts[0].cast("int").alias("x"), parts[1].cast("int").alias("y"))
    ends = w.agg(F.max("line").alias("x")).crossJoin(ab.agg(F.max("line").alias("y"))).first()  # two numbers
    if ends["x"] != ends["y"]:
        raise ValueError("weights and assignments differ in length")
    if not zero_indexed:
        ab = ab.where("x > 0 AND y > 0").select("line", (F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"))
    ab = ab.where("x >= 0 AND y >= 0 AND x <> y")
    return ab.join(w, "line").select(F.col("line").alias("sid"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w")


def save_analysis(path: str, metadata: dict | None = None, compression: str = "gzip", **sections: DataFrame) -> None:
    """Each section as a Parquet dataset below path, and the scalar metadata as one JSON row."""
    for name, df in sections.items():
        writer = df.write.mode("overwrite").option("compression", compression)
        (writer.partitionBy("r") if name == "samples" else writer).parquet(f"{path}/{name}")
    if sections:
        spark = next(iter(sections.values())).sparkSession
        plain = {k: v for k, v in (metadata or {}).items() if isinstance(v, str | int | float | bool)}
        spark.createDataFrame([(json.dumps({"sections": sorted(sections), **plain}),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def load_analysis(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """(metadata, sections) as saved."""
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first()["meta"])
    return meta, {name: spark.read.parquet(f"{path}/{name}") for name in meta.pop("sections")}


def save_result(path: str, edge_stats: DataFrame, samples: DataFrame | None = None, observed: DataFrame | None = None, metadata: dict | None = None, compression: str = "gzip") -> None:
    """A bootstrap result: its statistics and, if given, its replicates and the observed graph."""
    some = {"samples": samples, "observed": observed}
    save_analysis(path, metadata, compression, edge_stats=edge_stats, **{k: v for k, v in some.items() if v is not None})


def load_result(spark: SparkSession, path: str) -> dict:
    """edge_stats, samples and observed (None if not saved) and metadata."""
    meta, sections = load_analysis(spark, path)
    return {"metadata": meta, **{k: sections.get(k) for k in ("edge_stats", "samples", "observed")}}


#: Sections of a full analysis besides those of a result.
SECTIONS = ("edge_classes", "partitions", "coassignment", "consensus", "metrics", "hubs")


def load_full_analysis(spark: SparkSession, path: str) -> dict:
    """A result with SECTIONS, each None if it was not saved; the distributions over runs follow from partitions."""
    meta, sections = load_analysis(spark, path)
    return {"metadata": meta, **{k: sections.get(k) for k in ("edge_stats", "samples", "observed", *SECTIONS)}}


def matrix_rows(edges: DataFrame, nodes: DataFrame, value: str, template: str = "%.6f") -> DataFrame:
    """(i, row): the dense symmetric matrix of (i, j, value) as one tab-separated line a node, zeros where no edge is."""
    both = edges.select("i", "j", F.col(value).alias("v")).unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col(value).alias("v")))
    grid = nodes.select(F.col("node").alias("i")).crossJoin(nodes.select(F.col("node").alias("j")))  # parcels only
    cells = grid.join(both, ["i", "j"], "left").withColumn("t", F.format_string(template, F.coalesce(F.col("v"), F.lit(0)).cast("int" if template == "%d" else "double")))
    return cells.groupBy("i").agg(F.concat_ws("\t", F.transform(F.sort_array(F.collect_list(F.struct("j", "t"))), lambda x: x["t"])).alias("row"))


def _one_file(rows: DataFrame, path: str) -> None:
    """Write the lines of rows, which are few (a row a node), as one file, whole or not at all."""
    parts = f"{path}.parts"
    rows.coalesce(1).write.mode("overwrite").text(parts)
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    store = at(path).getFileSystem(conf)
    part = next(f.getPath() for f in store.listStatus(at(parts)) if f.getPath().getName().startswith("part-"))
    store.delete(at(path), True)
    store.rename(part, at(path))
    store.delete(at(parts), True)


def export_matrices(edge_stats: DataFrame, nodes: DataFrame, out: str, subject: str, session: str | None = None, atlas: str = "Schaefer100", space: str = "MNI152NLin2009cAsym", classes: DataFrame | None = None, coassigned: DataFrame | None = None, consensus: DataFrame | None = None, metadata: dict | None = None) -> dict[str, str]:
    """Text matrices and a JSON sidecar below out/sub-X/[ses-Y/]dwi; returns their paths.

    classes(i, j, label), coassigned(i, j, p) and consensus(node, community) are written if given; the sidecar has the
    class counts if classes are given, and the scalar metadata.
    """
    at = f"{out}/sub-{subject}/" + (f"ses-{session}/" if session else "") + "dwi"
    stem = "_".join([f"sub-{subject}", *([f"ses-{session}"] if session else []), f"space-{space}", f"atlas-{atlas}"])
    tables = {n: (edge_stats, c, "%.6f") for n, c in {"mean": "mean", "std": "std", "cv": "cv", "pnonzero": "p_nonzero", "cilow": "ci_low", "cihigh": "ci_high"}.items()}
    if classes is not None:
        tables["edgeclass"] = (classes, "label", "%d")
    if coassigned is not None:
        tables["coassignment"] = (coassigned, "p", "%.4f")
    made = {}
    for name, (edges, column, template) in tables.items():
        made[name] = f"{at}/{stem}_desc-{name}_relmat.tsv"
        _one_file(matrix_rows(edges, nodes, column, template).orderBy("i").select("row"), made[name])
    if consensus is not None:
        made["consensus"] = f"{at}/{stem}_desc-consensus_partition.tsv"
        _one_file(consensus.orderBy("node").select(F.format_string("%d", F.col("community").cast("int")).alias("row")), made["consensus"])
    spark = edge_stats.sparkSession
    side = {"atlas": atlas, "space": space, **{k: v for k, v in (metadata or {}).items() if isinstance(v, str | int | float | bool)}}
    side["classification_thresholds"] = {"robust": ">95% presence AND CV < 0.5", "present": ">50% presence", "fragile": "5-50% presence", "spurious": "<5% presence"}
    if classes is not None:
        counts = {r["label"]: r["n"] for r in classes.groupBy("label").agg(F.count("*").alias("n")).collect()}  # five rows
        side |= {f"n_{n}": counts.get(k, 0) for k, n in ((4, "robust"), (3, "present"), (2, "fragile"), (1, "spurious"))}
    made["sidecar"] = f"{at}/{stem}_desc-bootstrap_relmat.json"
    _one_file(spark.createDataFrame([(json.dumps(side, indent=2),)], "value string"), made["sidecar"])
    return made
