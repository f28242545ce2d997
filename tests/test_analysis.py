"""The permutation, bootstrap and sampling parts against plain NumPy, on small made data."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorra.functions.special import t_p_value
from quorra.operators import edges as E
from quorra.operators import graph as G
from quorra.operators import inference as I
from quorra.operators import kernels as K
from quorra.operators import plotdata as P
from quorra.operators import tract as T
from quorra.operators import voxel as V
from quorra.sources import files

N = 8


@pytest.fixture(scope="module")
def samples(spark):
    draw = np.random.default_rng(1)
    rows = [(r, i, j, float(draw.exponential(5))) for r in range(12) for i in range(N) for j in range(i + 1, N) if draw.random() < 0.6]
    return spark.createDataFrame(rows, "r long, i int, j int, w double")


@pytest.fixture(scope="module")
def cohort(spark):
    draw = np.random.default_rng(2)
    rows = [(s, 1 + s // 8, i, j, float(max(0.0, draw.normal(10 - 4 * (s // 8) * (i < 4 and j < 4), 1.0)))) for s in range(16) for i in range(N) for j in range(i + 1, N)]
    return spark.createDataFrame(rows, "subject int, grp int, i int, j int, w double")


def matrices(samples, r="r"):
    out = collections.defaultdict(lambda: np.zeros((N, N)))
    for row in samples.collect():
        out[row[r]][row["i"], row["j"]] = out[row[r]][row["j"], row["i"]] = row["w"]
    return out


def islands(t, threshold):
    found, k = [], 0
    while k < len(t):
        if abs(t[k]) > threshold:
            e = k
            while e + 1 < len(t) and abs(t[e + 1]) > threshold:
                e += 1
            part = t[k : e + 1]
            found.append((k, e, e - k + 1, np.abs(part).sum(), part[np.argmax(np.abs(part))]))
            k = e
        k += 1
    return found


def test_tract_clusters_are_signed_and_tested(spark):
    draw = np.random.default_rng(99)
    first, second = draw.normal(1, 0.02, (8, 20)), draw.normal(1, 0.02, (8, 20))
    second[:, 5:9] -= 0.1
    first[:, 14:16] -= 0.1
    lines = [(s + 8 * g, g + 1, k, float(v)) for g, m in enumerate((first, second)) for s, row in enumerate(m) for k, v in enumerate(row)]
    df = spark.createDataFrame(lines, "sid int, grp int, pt int, v double")
    sp = np.sqrt((first.var(axis=0, ddof=1) + second.var(axis=0, ddof=1)) / 2)
    t = (first.mean(axis=0) - second.mean(axis=0)) / (sp * np.sqrt(2 / 8))
    got = {(r["first_pt"], r["last_pt"]): r for r in T.tract_clusters(df, 200, 2.0).collect()}
    want = islands(t, 2.0)
    assert set(got) == {(a, b) for a, b, *_ in want}
    for a, b, extent, mass, peak in want:
        r = got[a, b]
        assert r["extent"] == extent and np.isclose(r["mass"], mass) and np.isclose(r["peak"], peak)
    assert got[14, 15]["peak"] < 0 and got[5, 8]["p"] < 0.05
    rows = {r["pt"]: r for r in T.compare_tract_profiles(df, 200, "cluster", 2.0).collect()}
    assert all(np.isclose(rows[k]["p"], t_p_value(float(t[k]), 14), atol=1e-9) for k in range(20))
    assert all(rows[k]["p_corrected"] == got[5, 8]["p"] for k in range(5, 9)) and rows[0]["p_corrected"] == 1
    ps = np.array([t_p_value(float(x), 14) for x in t])
    order = np.argsort(ps)
    fdr = np.minimum(1, np.minimum.accumulate((ps[order] * 20 / np.arange(1, 21))[::-1])[::-1])
    rows = {r["pt"]: r for r in T.compare_tract_profiles(df, correction="fdr").collect()}
    assert np.allclose([rows[k]["p_corrected"] for k in order], fdr)


def test_resampling_in_space(spark):
    draw = np.random.default_rng(4)
    lines = {0: draw.normal(0, 5, (12, 3)), 1: np.tile([[1.0, 2.0, 3.0]], (4, 1)), 2: np.array([[0.0, 0, 0]]), 3: np.array([[0.0, 0, 0], [0, 0, 0], [3, 4, 0], [3, 4, 0]])}
    rows = [(s, k, *map(float, p)) for s, m in lines.items() for k, p in enumerate(m)]
    got = collections.defaultdict(dict)
    for r in T.resample_streamlines(spark.createDataFrame(rows, "sid int, pt int, x double, y double, z double"), 9).collect():
        got[r["sid"]][r["k"]] = (r["x"], r["y"], r["z"])
    for s, m in lines.items():
        far = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(m, axis=0), axis=1))])
        want = np.stack([np.interp(np.linspace(0, far[-1], 9), far, m[:, c]) for c in range(3)], axis=1) if far[-1] else np.tile(m[0], (9, 1))
        assert len(got[s]) == 9 and np.allclose([got[s][k] for k in range(9)], want, atol=1e-7)


def test_volume_sampling(spark):
    draw = np.random.default_rng(5)
    cells, affine = draw.random((5, 6, 7)), np.array([[2.0, 0.3, 0, -1], [0, 1.5, 0, 2], [0, 0, 1.0, 0], [0, 0, 0, 1]])
    volume = spark.createDataFrame([(i, j, k, float(cells[i, j, k])) for i in range(5) for j in range(6) for k in range(7)], "i int, j int, k int, v double")
    pts = {s: draw.uniform(-4, 14, (6, 3)) for s in range(4)}
    df = spark.createDataFrame([(s, k, *map(float, p)) for s, m in pts.items() for k, p in enumerate(m)], "sid int, pt int, x double, y double, z double")
    again = {(r["sid"], r["k"]): np.array([r["x"], r["y"], r["z"], 1]) for r in T.resample_streamlines(df, 5).collect()}
    rows = T.tract_profile_from_streamlines(df, volume, affine, (5, 6, 7), 5).collect()
    assert len(rows) == 20
    for r in rows:
        spot = np.clip((np.linalg.inv(affine) @ again[r["sid"], r["pt"]])[:3], 0, [4, 5, 6])
        low = np.minimum(np.floor(spot).astype(int), [4, 5, 6])
        f, want = spot - low, 0.0
        for c in np.ndindex(2, 2, 2):
            at = np.minimum(low + c, [4, 5, 6])
            want += np.prod(np.where(c, f, 1 - f)) * cells[tuple(at)]
        assert np.isclose(r["v"], want, atol=1e-6)


def test_hub_bootstrap(samples):
    community = [0, 0, 0, 0, 1, 1, 1, 1]
    got = {r["node"]: r for r in K.hub_summary(K.hub_samples(samples, N, community, 60)).collect()}
    member, classes, parts = np.eye(2)[community], [], []
    for m in matrices(samples).values():
        s = m.sum(axis=1)
        p = 1 - (((m @ member) / np.maximum(s, 1e-300)[:, None]) ** 2).sum(axis=1)  # 1 without edges
        classes.append([0 if s[k] <= np.percentile(s, 60) else 1 if p[k] < 0.3 else 2 if p[k] < 0.75 else 3 for k in range(N)])
        parts.append(p)
    classes, parts = np.array(classes), np.array(parts)
    for k in range(N):
        count = np.bincount(classes[:, k], minlength=4)
        assert np.isclose(got[k]["hub_probability"], (classes[:, k] > 0).mean()) and got[k]["hub_class"] == count.argmax()
        assert np.isclose(got[k]["stability"], count.max() / len(classes)) and np.isclose(got[k]["participation_mean"], parts[:, k].mean())
        assert got[k]["betweenness_low"] <= got[k]["betweenness_mean"] <= got[k]["betweenness_high"] + 1e-12


def test_rich_club_and_small_world_summaries(samples):
    values = K.rich_club_normalized(samples, N, 3, (2, 4))
    rows = {r["k"]: r for r in K.rich_club_summary(values).collect()}
    each = collections.defaultdict(list)
    for r in values.collect():
        each[r["k"]].append(r["phi"])
    assert set(rows) == {2, 3, 4}
    for k, phi in each.items():
        assert np.isclose(rows[k]["phi_mean"], np.mean(phi)) and np.isclose(rows[k]["phi_std"], np.std(phi)) and np.isclose(rows[k]["phi_low"], np.percentile(phi, 2.5))
    assert P.rich_club_curves(K.rich_club_summary(values)).count() == 6
    assert {r["metric"] for r in K.small_world_summary(K.small_world_propensity(samples.where("r < 2"), N, 2, 2)).collect()} == {"phi", "clustering", "path_length", "delta_c", "delta_l"}


def test_communicability_nodes(samples):
    got = {r["node"]: r for r in K.communicability_nodes(K.communicability_cells(samples, N)).collect()}
    full = [K.communicability(m) for m in matrices(samples).values()]
    for k in range(N):
        assert np.isclose(got[k]["mean"], np.mean([c[k].sum() for c in full])) and np.isclose(got[k]["subgraph_mean"], np.mean([c[k, k] for c in full]))


def test_communities(samples):
    found, consensus = K.community_detection(samples, N, 6)
    assert {r["r"] for r in found.collect()} == set(range(6)) and consensus.count() == N
    spread = P.community_spread(found).collect()
    assert sum(r["runs"] for r in spread) == 6
    classes = samples.select("i", "j").distinct().withColumn("label", F.when(F.col("i") < 4, 4).otherwise(2))
    kept = K.community_detection(samples, N, 6, classes)[0].where("node >= 5").groupBy("r").agg(F.countDistinct("community").alias("n")).collect()
    assert len(kept) == 6


def test_parametric_samples(spark):
    stats = spark.createDataFrame([(0, 1, 10.0, 2.0), (0, 2, 0.1, 3.0)], "i int, j int, mean double, std double")
    rows = E.samples_of(stats, 4000).collect()
    first = np.array([r["w"] for r in rows if r["j"] == 1])
    assert len(first) == 4000 and abs(first.mean() - 10) < 0.15 and abs(first.std() - 2 / np.sqrt(2)) < 0.1  # two normals averaged
    assert min(r["w"] for r in rows) == 0
    stored = spark.createDataFrame([(r, 0, 1, 1.0) for r in range(9)], "r int, i int, j int, w double")
    assert E.samples_of(stats, 4, stored).count() == 4


def test_network_statistics(cohort):
    tests = {(r["i"], r["j"]): r["t"] for r in I.edge_ttest(cohort).collect()}
    rows = K.nbs_edges(cohort, N, 3.0, 60).collect()
    assert {(r["i"], r["j"]) for r in rows} == {e for e, t in tests.items() if abs(t) > 3}
    block = [r for r in rows if r["i"] < 4 and r["j"] < 4]
    assert len(block) == 6 and all(r["p"] < 0.05 and r["significant"] and r["t"] > 0 for r in block)
    free = {(r["i"], r["j"]): r for r in K.tfnbs_tested(cohort, N, 60).collect()}
    assert all(free[i, j]["significant"] for i in range(4) for j in range(i + 1, 4)) and all(0 <= r["p"] <= 1 for r in free.values())
    t = np.zeros((N, N))
    for (i, j), v in tests.items():
        t[i, j] = t[j, i] = v
    scores = K.tfnbs_scores(np.round(t, 9))
    assert all(np.isclose(r["score"], scores[e]) for e, r in free.items())


def test_t_of_nearly_equal_subjects(spark):
    draw = np.random.default_rng(5)
    equal, near = [864.3217 * (1.0 if s < 12 else 0.7) for s in range(24)], [5000 + (s < 12) + 1e-3 * draw.random() for s in range(24)]
    gaps = [float(s) if s % 3 else 0.0 for s in range(24)]
    x = {(0, 1): equal, (0, 2): near, (1, 2): gaps}
    rows = [(s, 1 + s // 12, i, j, w[s]) for (i, j), w in x.items() for s in range(24) if w[s]]
    table = spark.createDataFrame(rows, "subject int, grp int, i int, j int, w double")
    got = {(r["i"], r["j"]): r["t"] for r in I.edge_ttest(table).collect()}
    t = lambda w: (np.mean(w[:12]) - np.mean(w[12:])) / np.sqrt(np.var(w[:12], ddof=1) / 12 + np.var(w[12:], ddof=1) / 12)
    assert got[0, 1] == 0 and np.isclose(got[0, 2], t(near), rtol=1e-9) and np.isclose(got[1, 2], t(gaps), rtol=1e-12)
    assert {(r["i"], r["j"]) for r in K.tfnbs(K.permuted_tests(table.where("i + j <> 2"), 1).where("perm = 0"), 3).collect()} == {(1, 2)}


def test_t_of_groups_with_fewer_than_two_subjects(spark):
    for rows in ([(0, 1, 0, 1, 2.0), (1, 2, 0, 1, 3.0), (2, 2, 0, 1, 4.0)], [(0, 1, 0, 1, 2.0), (1, 1, 0, 1, 3.0)]):
        assert [r["t"] for r in I.edge_ttest(spark.createDataFrame(rows, "subject int, grp int, i int, j int, w double")).collect()] == [0.0]


def test_largest_scores_of_relabellings(cohort):
    tests = K.permuted_tests(cohort, 7)
    want = collections.defaultdict(float)
    for r in K.tfnbs(tests, N).collect():
        want[r["perm"]] = max(want[r["perm"]], abs(r["score"]))
    assert {r["perm"]: r["top"] for r in K.tfnbs_largest(tests, N).collect()} == want and len(want) == 8


def test_stability_of_edges(spark):
    rows = [(f"{s}-{i}-{k}", s, 1 + s // 6, i, i + 1, 1e6 * (5.0 if s < 6 and i == 0 else 1.0)) for s in range(12) for i in range(3) for k in range(30)]
    lines = spark.createDataFrame(rows, "sid string, subject int, grp int, a int, b int, w double")
    from quorra.plans.sql import Spark, run

    drawn = run(spark, I.subject_samples_steps(Spark, 4), subject_lines=lines)
    freq = {(r["i"], r["j"]): r["freq"] for r in I.nbs_stability(drawn, 4, 6.0, 20).collect()}
    assert freq[0, 1] == 1 and freq[1, 2] < 0.5 and freq[2, 3] < 0.5


def test_effect_sizes(cohort):
    rows = {(r["i"], r["j"]): r for r in I.permutation_test_edges(cohort, 40, n_nodes=N).collect()}
    by = collections.defaultdict(lambda: ([], []))
    for r in cohort.collect():
        by[r["i"], r["j"]][r["grp"] - 1].append(r["w"])
    for e, (a, b) in by.items():
        pooled = np.sqrt((7 * np.var(a, ddof=1) + 7 * np.var(b, ddof=1)) / 14)
        assert np.isclose(rows[e]["d"], (np.mean(a) - np.mean(b)) / pooled, atol=1e-6)
    scalars = cohort.groupBy("subject").agg(F.max("w").alias("x"))
    top = I.permutation_test_global(cohort, scalars, 40).first()
    x = {r["subject"]: r["x"] for r in scalars.collect()}
    a, b = [x[s] for s in range(8)], [x[s] for s in range(8, 16)]
    assert np.isclose(top["diff"], np.mean(a) - np.mean(b), atol=1e-7)
    assert np.isclose(top["d"], top["diff"] / np.sqrt((np.var(a, ddof=1) + np.var(b, ddof=1)) / 2))


def test_latent_variables(spark, cohort):
    wide = cohort.select("subject", (F.col("i") * N + F.col("j")).cast("long").alias("feature"), F.col("w").alias("x"))
    behaviors = spark.createDataFrame([(s, v, float((8 - s // 8 * 4) + v * (s % 3))) for s in range(16) for v in range(2)], "subject int, var int, y double")
    x = wide.toPandas().pivot(index="subject", columns="feature", values="x").to_numpy()
    y = behaviors.toPandas().pivot(index="subject", columns="var", values="y").to_numpy()
    u, s, _ = np.linalg.svd((x - x.mean(0)).T @ (y - y.mean(0)), full_matrices=False)
    rows = {r["component"]: r for r in K.pls(wide, behaviors, 2, 60, 60).collect()}
    assert np.allclose([rows[k]["singular_value"] for k in range(2)], s[:2]) and np.isclose(rows[0]["explained"], s[0] ** 2 / (s[:2] ** 2).sum())
    assert rows[0]["p"] < 0.05 and rows[0]["n_reliable"] >= 6
    weights = K.pls_tables(wide, behaviors, 2, 1, 30)[1]
    first = [r["weight"] for r in weights.where("component = 0").orderBy("feature").collect()]
    assert np.allclose(np.abs(first), np.abs(u[:, 0]))
    one = behaviors.where("var = 0").select("subject", F.col("y").alias("value"))
    scores = {r["subject"]: r for r in I.pls_scores(cohort, one).collect()}
    c = (x - x.mean(0)).T @ (y[:, 0] - y[:, 0].mean())
    assert np.allclose([scores[k]["brain"] for k in range(16)], (x - x.mean(0)) @ (c / np.linalg.norm(c)))


def test_predictive_model(cohort, spark):
    behavior = spark.createDataFrame([(s, float(50 - 10 * (s // 8) + s % 5)) for s in range(16)], "subject int, value double")
    made = I.predictive_model_summary(cohort, behavior, 20)
    assert made["r"] > 0.8 and made["p"] < 0.001 and made["edges_positive"] >= 6
    assert I.predictive_model(cohort, behavior, 20).count() == 16


def test_voxel_mask_and_gradients(spark):
    draw = np.random.default_rng(3)
    bvecs = draw.normal(size=(20, 3))
    bvecs /= np.linalg.norm(bvecs, axis=1)[:, None]
    bvals = np.array([0.0, 0, *[1000.0] * 18])
    signals = spark.createDataFrame([(v, g, float(abs(draw.normal(500, 50)))) for v in range(4) for g in range(20)], "voxel int, g int, s double")
    mask = spark.createDataFrame([(v, int(v != 2)) for v in range(4)], "voxel int, inside int")
    rows = V.wild_bootstrap_dti(signals, bvals, bvecs, mask, 3).collect()
    assert len(rows) == 3 * 4 * 6 and all((r["value"] == 0) == (r["voxel"] == 2) for r in rows)
    rows = V.residual_bootstrap_csd(signals, bvecs, [1.0, 0.5, 0.1], mask, 4, 2).collect()
    assert len(rows) == 2 * 4 * 15 and all(r["value"] >= 0 for r in rows) and all(r["value"] == 0 for r in rows if r["voxel"] == 2)


def test_export_and_full_analysis(spark, tmp_path):
    stats = spark.createDataFrame([(0, 1, 2.0, 0.5, 0.25, 1.0, 1.5, 2.5), (1, 2, 1.0, 0.1, 0.1, 0.4, 0.8, 1.2)], "i int, j int, mean double, std double, cv double, p_nonzero double, ci_low double, ci_high double")
    nodes = spark.range(3).select(F.col("id").cast("int").alias("node"))
    classes, consensus = E.classify_edges(stats), spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "node int, community int")
    together = spark.createDataFrame([(0, 1, 0.75)], "i int, j int, p double")
    made = files.export_matrices(stats, nodes, str(tmp_path), "01", "a", classes=classes, coassigned=together, consensus=consensus, metadata={"n_bootstrap": 7})
    read = lambda k: open(made[k]).read().split("\n")[:-1]
    assert read("mean") == ["0.000000\t2.000000\t0.000000", "2.000000\t0.000000\t1.000000", "0.000000\t1.000000\t0.000000"]
    assert read("edgeclass") == ["0\t4\t0", "4\t0\t2", "0\t2\t0"] and read("coassignment")[0] == "0.0000\t0.7500\t0.0000" and read("consensus") == ["1", "1", "0"]
    side = json.loads("\n".join(read("sidecar")))
    assert side["n_robust"] == 1 and side["n_fragile"] == 1 and side["n_bootstrap"] == 7
    files.save_analysis(str(tmp_path / "x"), {"n_bootstrap": 7}, edge_stats=stats, edge_classes=classes, consensus=consensus)
    back = files.load_full_analysis(spark, str(tmp_path / "x"))
    assert back["metadata"]["n_bootstrap"] == 7 and back["samples"] is None and back["edge_classes"].count() == 2
    files.save_result(str(tmp_path / "y"), stats, observed=stats.select("i", "j", "mean"))
    assert files.load_result(spark, str(tmp_path / "y"))["observed"].count() == 2


def test_table_functions(spark, samples):
    one = samples.where("r = 0").drop("r")
    nodes = spark.range(N).select(F.col("id").cast("int").alias("node"))
    partition = nodes.withColumn("community", F.col("node") % 2)
    assert G.hub_classes(one, nodes, partition).count() == N and G.rich_club(one, nodes, 5).count() == 5
    kept = E.disparity_summary(one, 0.5).first()
    assert 0 <= kept["n_retained"] <= kept["n_total"] == one.count() and 0 <= kept["weight_retained"] <= 1
    assert P.ordered_nodes(partition).where("boundary = 1").count() == 1
    scores = G.node_strength(one, nodes=nodes).select("node", F.col("strength").alias("stability"), F.when(F.col("node") > 0, F.col("strength") * 2 + 1).alias("score"))
    rows = P.clinical(scores, 2).collect()
    assert len(rows) == 4 and all(r["node"] > 0 and np.isclose(r["slope"], 2) for r in rows)
    r, p = P.clinical_correlation(scores)
    assert np.isclose(r, 1) and p < 1e-9
    assert P.clinical(scores.withColumn("score", F.lit(1.0)), 1).first()["r"] is None
    stats = one.groupBy("i", "j").agg(F.lit(0.0).alias("mean"), F.lit(0.0).alias("std"), F.lit(0.0).alias("cv"))
    assert P.uncertainty(stats).first()["mean_low"] is None  # cells of no weight do not count


def test_normal_interval(spark):
    small = spark.createDataFrame([(k, k % 3, 3 + k % 2, 100 + 7 * k) for k in range(40)], "sid long, a int, b int, w long")
    by = {}
    for kind in ("percentile", "normal"):
        by[kind] = {(r["i"], r["j"]): r for r in E.bootstrap_edge_stats(small, 60, interval=kind).collect()}
    for e, r in by["normal"].items():
        assert r["mean"] == by["percentile"][e]["mean"] and np.isclose(r["ci_high"], r["mean"] + 1.959964 * r["std"], rtol=1e-5)
        assert np.isclose(r["ci_low"], max(0, r["mean"] - 1.959964 * r["std"]), rtol=1e-5, atol=1e-3)


def test_multinomial_draws_over_blocks(spark):
    from collections import Counter
    from hashlib import md5

    from quorra.operators.draws import heads, multinomial, pack, unpack

    assert all(heads("42:7:", k, k + 40).tolist() == [int(md5(f"42:7:{x}".encode()).hexdigest()[:8], 16) for x in range(k, k + 40)] for k in (0, 90, 99_980, 4_294_967_280))
    steps = np.array([0, 254, 255, 256, 3000, 0])
    assert (unpack(pack(steps)) == np.cumsum(steps)).all()
    rows = [(k, k * k % 5, k % 4, 1000 + 13 * k) for k in range(300)]  # self-loops and both directions among them
    want = Counter()
    for r in range(-1, 6):
        for k in range(300):
            _, a, b, w = rows[k if r < 0 else int(md5(f"42:{r}:{k}".encode()).hexdigest()[:8], 16) % 300]
            if a != b:
                want[r, min(a, b), max(a, b)] += w
    spread = [(3 * k + 5, a, b, w) for k, a, b, w in rows]  # numbers with gaps: their order counts
    for given in (rows, spread):
        for kind in ("long", "double"):
            lines = spark.createDataFrame([(*x[:3], int(x[3]) if kind == "long" else float(x[3])) for x in given], f"sid long, a int, b int, w {kind}").repartition(3)
            got = multinomial(lines, 6, chunk=64, shift=5).collect()
            assert len(got) == len(want) and all(want[x["r"], x["i"], x["j"]] == x["w"] for x in got)
    assert multinomial(lines.where("sid < 0"), 6).count() == 0
    # a row a block and unit goes through the shuffle, whatever the number of draws
    from quorra.operators.draws import _pieces

    assert sum(1 for unit in range(50) for _ in _pieces(200_000, 50, 42, unit, 1 << 22, 20)) == 50
    assert sum(len(x[2]) for x in _pieces(200_000, 50, 42, 0, 1 << 22, 20)) < 200_000


def test_waves_of_draws_give_the_same_resamples(spark):
    from quorra.operators.draws import multinomial

    lines = spark.createDataFrame([(k, k % 5, k % 7, 3 * k + 1) for k in range(200)], "sid long, a int, b int, w long")
    whole = sorted(map(tuple, multinomial(lines, 6).collect()))
    assert {r[0] for r in whole} == set(range(-1, 6))
    for wave in (1, 400, 1_100):  # 1, 2 and 5 replicates at a time
        assert sorted(map(tuple, multinomial(lines, 6, chunk=64, shift=5, wave=wave).collect())) == whole


def test_draws_of_millions_of_rows_take_a_third_of_a_byte():
    from quorra.operators.draws import CHUNK, SHIFT, _pieces

    rows = 1 << 23
    assert sum(len(x[2]) for unit in range(-(-rows // CHUNK)) for x in _pieces(rows, 1, 42, unit, CHUNK, SHIFT)) < rows / 3
