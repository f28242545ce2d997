"""Every query with SQL gives the rows that DuckDB gives; the others keep their invariants."""

from pathlib import Path

import pytest

from quorra import oracles, registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, duck, data, name):
    got = registry.queries()[name](spark, data).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    got, want = (x[order].sort_values(order).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in order:
        same = (got[c].astype(want[c].dtype) == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), c


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows
    assert {r["label"] for r in rows} <= {0, 1, 2, 3, 4}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nbs_and_tfnbs(spark, data):
    rows = registry.queries()["nbs_fwer"](spark, data).collect()
    assert rows and all(0 <= r["p"] <= 1 for r in rows)
    assert registry.queries()["tfnbs"](spark, data).where("score = 0").count() == 0


def _light_lines(duck, data, folder, factor, customers="true"):
    """The tables with lower prices, so that some subjects have no edge above 0.3, and DuckDB on them."""
    import shutil

    import duckdb

    for f in ("lineitem", "orders", "customer", "supplier", "nation", "embeddings", "events"):
        shutil.copy(f"{data}/{f}.parquet", folder)
    duck.sql(f"COPY (SELECT * REPLACE (l_extendedprice * {factor} AS l_extendedprice) FROM lineitem) TO '{folder}/lineitem.parquet' (FORMAT parquet)")
    duck.sql(f"COPY (SELECT * FROM customer WHERE {customers}) TO '{folder}/customer.parquet' (FORMAT parquet)")
    base = duckdb.connect()
    for f in ("lineitem", "orders", "customer", "supplier", "nation"):
        base.sql(f"CREATE VIEW {f} AS SELECT * FROM '{folder}/{f}.parquet'")
    return base


def test_global_edges_count_subjects_without_any(spark, duck, data, tmp_path):
    base = _light_lines(duck, data, tmp_path, 0.006)
    strong = base.sql(f"WITH {oracles._cohort()} SELECT count(*) FILTER (w > 0.3) AS n FROM e GROUP BY subject").df()["n"]
    assert strong.min() == 0 < strong.max() and len(strong) == 24
    got = registry.queries()["perm_global_edges"](spark, str(tmp_path)).collect()
    want = base.sql(registry.oracle_sql()["perm_global_edges"]).df()
    assert [r.asDict() for r in got] == want[list(got[0].asDict())].to_dict("records")


def test_global_edges_of_two_subjects(spark, duck, data, tmp_path):
    _light_lines(duck, data, tmp_path, 1, "c_custkey % 24 IN (1, 13)")
    assert [r["d"] for r in registry.queries()["perm_global_edges"](spark, str(tmp_path)).collect()] == [0.0]


def test_tfnbs_relabels_as_often_as_the_method(spark, data):
    rows = registry.queries()["tfnbs"](spark, data).collect()
    counts = [r["p"] * 5000 for r in rows]
    assert all(abs(n - round(n)) < 1e-6 for n in counts)
    assert any(round(n) % 250 for n in counts)  # finer than shares of 20
    assert "range(5001)" in registry.oracle_sql()["tfnbs"]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_give_rows(spark, data, name):
    rows = registry.queries()[name](spark, data).toPandas()
    assert len(rows)
    for low, mid, high in (("ci_low", "mean", "ci_high"),):
        if {low, mid, high} <= set(rows.columns):
            assert (rows[low] <= rows[high]).all()


def test_voxels_and_lines_are_whole_tables(spark, data):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect()}
    got = {n: registry.queries()[n](spark, data).select(c).distinct() for n, c in (("dti_wild_bootstrap", "voxel"), ("csd_residual_bootstrap", "voxel"), ("resample_streamline", "sid"))}
    assert all({r[0] for r in rows.collect()} == ids for rows in got.values())
    signals = registry._views(spark, data, registry._signals(registry.Spark))["signals"]
    assert signals.count() == len(ids) * 64  # what voxel_connectome tracks


def test_graph_queries_take_every_line(spark, duck, data):
    lines = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey"
    total = int(duck.sql(f"SELECT sum(cast(round(l_extendedprice * 100) AS bigint)) AS w {lines}").df()["w"][0])
    rows = registry.queries()["build_sc"](spark, data).collect()
    assert sum(r["w"] for r in rows) == total
    strength = registry.queries()["node_strength"](spark, data).collect()
    assert abs(sum(r["strength"] for r in strength) - 2 * total / 1e6) < 1e-3
    assert len(registry.queries()["edge_ttest"](spark, data).collect()) == len(rows)


@pytest.fixture(scope="module")
def many_lines(duck, data, tmp_path_factory):
    """The tables with every vector 42 times, under keys of its own: over 20,000 lines."""
    import shutil

    folder = tmp_path_factory.mktemp("many_lines")
    for f in ("lineitem", "orders", "customer", "supplier", "nation", "events"):
        shutil.copy(f"{data}/{f}.parquet", folder)
    duck.sql(f"COPY (SELECT * REPLACE (vec_id + z * 1000 AS vec_id) FROM embeddings, range(42) t(z)) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["tract_compare", "tract_compare_fdr", "plot_tract", "tract_compare_bonferroni"])
def test_profiles_of_many_lines(spark, duck, many_lines, name):
    import duckdb

    base = duckdb.connect()
    base.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{many_lines}/embeddings.parquet'")
    got, want = registry.queries()[name](spark, many_lines).toPandas(), base.sql(registry.oracle_sql()[name]).df()
    got, want = (x[sorted(x.columns)].sort_values("pt").reset_index(drop=True) for x in (got, want))
    assert len(got) == 64
    assert (got.astype(want.dtypes) == want).all(axis=None)


def test_p_of_t_is_the_same_by_series_and_by_integral(spark):
    from quorra.functions.special import t_p_value
    from quorra.operators.tract import t_p_steps
    from quorra.plans.sql import Spark, run

    points = [0.0, 0.3, 1.96, 3.9, 6.2, 45.0]
    for lines in (2_001, 5_000, 60_001):
        table = [("counts", f"SELECT 1000.0D AS n1, {lines - 1000}.0D AS n2"), ("tvals", "SELECT 0 AS perm, pt, 0.0D AS diff, t, 0.0D AS d FROM (VALUES " + ", ".join(f"({k}, {t}D)" for k, t in enumerate(points)) + ") AS v(pt, t)")]
        for degrees in (100, 20_000):
            rows = run(spark, [*table, *t_p_steps(Spark, "tvals", degrees)]).collect()
            assert len(rows) == len(points)
            assert all(abs(r["p"] - t_p_value(r["t"], lines - 2)) < 1e-9 for r in rows)


@pytest.mark.parametrize("name", ["bootstrap_edge_stats", "bootstrap_normal_ci", "parametric_samples", "plot_uncertainty"])
def test_resampled_queries_send_no_row_a_draw(spark, data, name):
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan or name == "parametric_samples"  # that one's normal draws are hashed too, a row a sample
    assert "lineitem" not in plan and "l_orderkey" not in plan  # what is left reads the resampled graphs


@pytest.mark.parametrize("name", ["bootstrap_normal_ci", "parametric_samples", "plot_uncertainty"])
def test_resampled_queries_leave_no_disk_behind(spark, data, name):
    import os
    import time

    from quorra.sources import shared

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffled = lambda: {f: os.path.getsize(os.path.join(at, f)) for d in disk for at, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_") and f.endswith(".data")}
    made, before = set(shared._made.get(spark.sparkContext.applicationId, [])), shuffled()
    registry.queries()[name](spark, data)
    left = set(shared._made[spark.sparkContext.applicationId]) - made
    assert left and all(p.rpartition("/")[2].startswith("edge-samples") for p in left)
    for _ in range(50):  # they go in the background; what stays is one count of the packed lines
        size = sum(n for f, n in shuffled().items() if f not in before)
        if size < 1_000:
            break
        time.sleep(0.2)
    assert size < 1_000


def test_resampled_lines_are_saved_in_order(spark, data, monkeypatch):
    import pyarrow.parquet as pq

    kept = []
    monkeypatch.setattr(registry, "remove", lambda spark, *paths: kept.extend(paths))
    registry.queries()["parametric_samples"](spark, data)
    files = [f for path in kept for f in Path(path.removeprefix("file:")).glob("*.parquet")]
    rows = [[(r["a"], r["b"], r["w"]) for r in pq.read_table(f, columns=["a", "b", "w"]).to_pylist()] for f in files]
    assert sum(map(len, rows)) > 1_000
    assert all(x == sorted(x) for x in rows)
