from pyspark.sql import functions as F

from quorra.operators.edges import bootstrap_edge_stats
from quorra.sources import files
from quorra.streaming.running import running_statistics


def test_assignments_round_trip(spark, tmp_path):
    (tmp_path / "w").write_text("1.5\n2\n3\n4\n")
    (tmp_path / "a").write_text("1 2\n2 1\n3 3\n0 4\n")
    rows = files.load_assignments(spark, str(tmp_path / "w"), str(tmp_path / "a")).orderBy("sid").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 1, 1.5), (1, 0, 1, 2.0)]


def test_save_load_and_text(spark, tmp_path):
    lines = spark.createDataFrame([(0, 0, 1, 2.0), (1, 0, 2, 3.0), (2, 0, 1, 1.0)], "sid long, a int, b int, w double")
    stats = bootstrap_edge_stats(lines, 20).cache()
    assert stats.where("ci_low > mean OR mean > ci_high OR std < 0").count() == 0
    files.save_analysis(str(tmp_path / "x"), {"n_bootstrap": 20}, edge_stats=stats)
    meta, sections = files.load_analysis(spark, str(tmp_path / "x"))
    assert meta == {"n_bootstrap": 20} and sections["edge_stats"].count() == stats.count()
    nodes = spark.range(3).select(F.col("id").cast("int").alias("node"))
    made = files.export_matrices(stats, nodes, str(tmp_path), "01")
    text = [r["value"] for r in spark.read.text(made["mean"]).collect()]
    assert len(text) == 3 and all(len(x.split("\t")) == 3 for x in text)


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = running_statistics(stream, "event_type", "value").writeStream.outputMode("complete").format("memory").queryName("running").start()
    run.processAllAvailable()
    run.stop()
    got = {r["event_type"]: (r["n"], round(r["std"], 8)) for r in spark.table("running").collect()}
    want = {r["event_type"]: (r["n"], round(r["std"], 8)) for r in running_statistics(events, "event_type", "value").collect()}
    assert got == want
