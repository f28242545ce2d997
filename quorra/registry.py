"""Queries of the library: each is an operator over views of the tables. Their SQL for DuckDB is written apart, in oracles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorra import oracles
from quorra.functions.special import critical_r
from quorra.operators import edges as E
from quorra.operators import graph as G
from quorra.operators import inference as I
from quorra.operators import kernels as K
from quorra.operators import plotdata as P
from quorra.operators import tract as T
from quorra.operators import voxel as V
from quorra.operators.draws import multinomial
from quorra.plans.sql import Spark, Steps, run
from quorra.sources import files, views
from quorra.sources.shared import fresh_dir, remove, saved
from quorra.streaming import running

TABLES = ("lineitem", "orders", "customer", "supplier", "nation", "embeddings", "events")
NODES = 25
B = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(steps: Steps, exact: str, rounded: str = "", digits: int = 6) -> Steps:
    """The last step's columns; those of the second list rounded well above the noise of summation order."""
    names = [*exact.split(), *(f"round({c}, {digits}) AS {c}" for c in rounded.split())]
    return [*steps, ("picked_columns", f"SELECT {', '.join(names)} FROM {steps[-1][0]}")]


def _stats(d) -> Steps:
    return E.edge_stats_steps(d, B)


AFFINE = np.array([[2.0, 0.0, 0.0, -4.0], [0.0, 2.0, 0.0, -4.0], [0.0, 0.0, 2.0, -4.0], [0.0, 0.0, 0.0, 1.0]])


def _signals(d) -> Steps:
    return [*views.profiles(d), ("signals", "SELECT sid AS voxel, pt AS g, 100 * exp(v) AS s FROM profiles")]


def _fixed_partitions(d) -> Steps:
    return [("partitions", f"SELECT r, n_nationkey AS node, (n_nationkey * (r + 3) + r) % 5 AS community FROM {{nation}} CROSS JOIN {d.series(8, 'r')} x")]


def _plans() -> dict[str, tuple[Callable, Callable]]:
    """name -> (views, steps)."""
    plain = lambda d: views.lines()
    streams = lambda d: views.streamlines()
    thinned = lambda d: views.streamlines("sparse")
    graph = lambda d: [*views.edges(), *views.partition(), *views.nodes()]
    group = lambda d: views.subject_edges()
    tiers = lambda d: views.subject_edges("tiered")
    brain = lambda d: [*views.subject_edges(), *views.behavior()]
    lines = lambda d: [*views.profiles(d), *views.bundle_weights()]
    flat, solid = views.plane_points, lambda d: [*views.space_points(d), *views.volume(d), *views.bundle_weights()]
    stats_cols = "observed mean std cv ci_low ci_high median iqr p_nonzero"
    t_steps = lambda d: I.ttest_steps("{subject_edges}")
    cut = critical_r(24, 0.01)
    bands = lambda d: [*T.tract_bootstrap_steps(d, 20)[:-2], ("bands", T.tract_bootstrap_steps(d, 20)[-2][1])]
    edge_count = [("metric", "SELECT subject, cast(count(CASE WHEN w > 0.3 THEN 1 END) AS double) AS x FROM {subject_edges} GROUP BY subject")]
    return {
        "build_sc": (plain, lambda d: _pick(E.build_sc_steps(), "i j w")),
        "bootstrap_edge_stats": (streams, lambda d: _pick(_stats(d), "i j", stats_cols)),
        "bootstrap_poisson": (streams, lambda d: _pick(E.edge_stats_steps(d, B, method="poisson"), "i j", stats_cols)),
        "bootstrap_normal_ci": (streams, lambda d: _pick(E.edge_stats_steps(d, B, interval="normal"), "i j", "mean ci_low ci_high", 5)),
        "classify_edges": (thinned, lambda d: _pick([*_stats(d), *E.classes_steps("edge_stats")], "i j label", "p_nonzero cv")),
        "classify_prevalence": (tiers, lambda d: _pick([*E.prevalence_steps(), *E.classes_steps("prevalence")], "i j label", "p_nonzero cv")),
        "edge_class_counts": (tiers, lambda d: [*E.prevalence_steps(), *E.classes_steps("prevalence"), *E.class_counts_steps("classes", str(NODES))]),
        "parametric_samples": (streams, lambda d: _pick([*_stats(d), *E.parametric_steps(d, 5, table="edge_stats")], "r i j", "w", 3)),
        "disparity_backbone": (graph, lambda d: _pick(E.disparity_steps(0.1), "i j kept", "w")),
        "disparity_summary": (graph, lambda d: _pick(E.disparity_summary_steps(0.1), "n_retained n_total", "weight_retained")),
        "assignments_from_sc": (graph, lambda d: _pick(E.expand_steps(d, 30), "a b k", "weight", 5)),
        "node_strength": (graph, lambda d: _pick(G.strength_steps(), "node degree", "strength")),
        "strength_summary": (graph, lambda d: _pick(G.summary_steps(), "", "density mean_strength strength_std")),
        "modularity_fixed": (graph, lambda d: _pick(G.modularity_steps(), "", "modularity")),
        "transitivity": (graph, lambda d: _pick(G.transitivity_steps(), "", "transitivity")),
        "clustering": (graph, lambda d: _pick(G.clustering_steps(), "", "clustering")),
        "participation": (graph, lambda d: _pick(G.participation_steps(), "node", "participation")),
        "within_module_z": (graph, lambda d: _pick(G.within_z_steps(), "node", "z")),
        "hub_class": (graph, lambda d: _pick(G.hub_steps(d), "node hub_class", "strength participation z")),
        "rich_club_phi": (lambda d: [*views.strong_edges(), *views.nodes()], lambda d: _pick(G.rich_club_steps(d), "k n_rich", "phi")),
        "coassignment_fixed": (_fixed_partitions, lambda d: _pick(G.coassignment_steps(), "i j", "p")),
        "edge_ttest": (group, lambda d: _pick(t_steps(d), "i j", "diff t", 3)),
        "perm_edges_fdr": (group, lambda d: _pick(I.permutation_edges_steps(d, 100, "fdr"), "i j", "diff p p_corrected d", 3)),
        "perm_edges_bonferroni": (group, lambda d: _pick(I.permutation_edges_steps(d, 100, "bonferroni"), "i j", "diff p p_corrected d", 3)),
        "perm_global_weight": (group, lambda d: _pick(I.permutation_global_steps(d, 200), "", "diff p d", 3)),
        "perm_global_edges": (group, lambda d: _pick(I.permutation_global_steps(d, 200, metric=edge_count), "", "diff p d", 3)),
        "perm_global_null": (group, lambda d: _pick(I.permutation_null_steps(d, 200), "perm", "delta", 2)),
        "nbs_stability": (lambda d: views.subject_lines(), lambda d: _pick([*I.subject_samples_steps(d, 5), *I.nbs_stability_steps(d, 5, 1.0, 12, table="subject_samples")], "i j", "freq")),
        "cpm_bagged": (brain, lambda d: _pick(I.cpm_steps(d, 20, cut), "subject", "actual predicted ci_low ci_high", 3)),
        "cpm_summary": (brain, lambda d: _pick(I.cpm_summary_steps(d, 20, cut), "n edges_positive edges_negative", "r", 4)),
        "pls_single": (brain, lambda d: _pick(I.pls_single_steps(), "i j", "weight", 6)),
        "pls_scores": (brain, lambda d: _pick(I.pls_scores_steps(), "subject", "brain behaviour", 5)),
        "tract_bootstrap": (lines, lambda d: _pick(T.tract_bootstrap_steps(d, 20), "pt", "mean std ci_low ci_high median q25 q75 observed")),
        "tract_compare": (lines, lambda d: _pick(T.tract_compare_steps(d, 100, "cluster", 1.0), "pt", "diff t d p p_corrected")),
        "tract_compare_fdr": (lines, lambda d: _pick(T.tract_compare_steps(d, 0, "fdr"), "pt", "diff t d p p_corrected")),
        "tract_compare_bonferroni": (lines, lambda d: _pick(T.tract_compare_steps(d, 0, "bonferroni"), "pt", "diff t d p p_corrected")),
        "tract_clusters": (lines, lambda d: _pick(T.tract_clusters_steps(d, 100, 1.0), "first_pt last_pt extent", "mass peak p", 5)),
        "bundle_stability": (lines, lambda d: _pick(T.bundle_stability_steps(d, 50), "label n_lines", "stability")),
        "resample_streamline": (flat, lambda d: _pick(T.resample_steps(d), "sid k", "x y", 4)),
        "tract_profile_volume": (solid, lambda d: _pick(T.sampled_profile_steps(d, AFFINE, (20, 20, 20)), "sid pt", "v", 4)),
        "tract_profile_summary": (solid, lambda d: _pick([*T.sampled_profile_steps(d, AFFINE, (20, 20, 20)), *T.profile_summary_steps("tract_profiles")], "pt", "mean std weighted_mean", 4)),
        "dti_wild_bootstrap": (_signals, lambda d: _pick(V.wild_steps(d, 3, *V.gradients()), "r voxel c", "value", 7)),
        "csd_residual_bootstrap": (_signals, lambda d: _pick(V.residual_steps(d, 2, [1.0, 0.5, 0.1], V.directions(64)), "r voxel c", "value", 4)),
        "plot_uncertainty": (streams, lambda d: _pick([*_stats(d), *P.uncertainty_steps(d, "edge_stats")], "", "mean_low mean_high std_low std_high cv_high mean_cv")),
        "plot_communities": (graph, lambda d: _pick(P.ordered_nodes_steps(), "node community place boundary")),
        "plot_clinical": (lambda d: [*graph(d), *views.node_scores()], lambda d: _pick([*G.strength_steps(), ("scores", "SELECT s.node, strength AS stability, score FROM strengths s JOIN {node_scores} c ON c.node = s.node"), *P.clinical_steps(table="scores")], "node side", "stability score r slope intercept", 4)),
        "plot_nbs": (group, lambda d: _pick([*t_steps(d), *P.nbs_steps(d, "ttest", 2.0)], "n_beyond", "t_high", 5)),
        "plot_hubs": (graph, lambda d: _pick([*G.hub_steps(d)[:-1], ("hubs", G.hub_steps(d)[-1][1]), *P.hub_order_steps("hubs")], "node hub_class by_strength by_participation by_class", "strength participation z")),
        "plot_cpm": (brain, lambda d: _pick([*I.cpm_steps(d, 20, cut)[:-1], ("predictions", I.cpm_steps(d, 20, cut)[-1][1]), *P.prediction_steps("predictions")], "", "r slope intercept width", 2)),
        "plot_pls": (brain, lambda d: _pick([*I.pls_scores_steps()[:-1], ("scores", I.pls_scores_steps()[-1][1]), *P.latent_variable_steps("scores")], "n", "r")),
        "plot_tract": (lines, lambda d: _pick([*[(f"x_{n}" if n in ("lines", "observed") else n, q.replace("FROM lines", "FROM x_lines").replace("JOIN lines", "JOIN x_lines")) for n, q in bands(d)], *T.tract_compare_steps(d, 0, "fdr")[:-1], ("compared", T.tract_compare_steps(d, 0, "fdr")[-1][1]), *P.tract_bands_steps("bands", "compared")], "pt significant", "mean ci_low ci_high t", 5)),
    }


def _views(spark: SparkSession, sf_dir: str, steps: Steps) -> dict[str, DataFrame]:
    """The views that steps define, one DataFrame each."""
    tables = {t: _table(spark, sf_dir, t) for t in TABLES}
    out = {}
    for k, (name, _) in enumerate(steps):
        used = {t: df for t, df in tables.items() if any("{" + t + "}" in q for _, q in steps[: k + 1])}
        out[name] = run(spark, [*steps[:k], (name, steps[k][1])], **used)
    return out


def _sampled(lines: DataFrame, steps: Steps) -> DataFrame:
    """Resamples of the last view of steps, from the saved rows of the first: they are counted and ranked without being joined again.

    Each task's rows are saved in order, so that like stands beside like: the table and the shuffle that ranks it take half.
    """
    spark, path = lines.sparkSession, fresh_dir(lines.sparkSession, "lines")
    made = saved(lines.sortWithinPartitions(*lines.columns), "lines", tidy=True, path=path)
    sampled = multinomial(run(spark, [(steps[0][0], "SELECT * FROM {lines}"), *steps[1:]], lines=made), B)
    remove(spark, path)
    return sampled


def _query(make_views, make_steps):
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        steps = make_steps(Spark)
        defined = make_views(Spark)
        inputs = _views(spark, sf_dir, defined) | {"nation": _table(spark, sf_dir, "nation")}
        if any("{sampled}" in q for _, q in steps):
            inputs["sampled"] = _sampled(inputs[defined[0][0]], defined)
        return run(spark, steps, **{n: df for n, df in inputs.items() if any("{" + n + "}" in q for _, q in steps)})

    return call


def _samples(spark: SparkSession, sf_dir: str, replicates: int = 20) -> DataFrame:
    """(r, i, j, w) of all streamlines, weights in units of a million hundredths; a row's draws are its own, so nothing is joined."""
    made = E.bootstrap_samples(_views(spark, sf_dir, views.streamlines())["streamlines"], replicates, method="poisson")
    return made.withColumn("w", F.col("w") / 1e6)


def _strong(samples: DataFrame) -> DataFrame:
    """Each replicate's edges above its mean weight: graphs with gaps."""
    from pyspark.sql.window import Window

    return samples.withColumn("mean", F.avg("w").over(Window.partitionBy("r"))).where("w > mean").drop("mean")


def _graph(spark, sf_dir):
    return _views(spark, sf_dir, views.edges())["edges"]


def _one(spark, sf_dir):
    return _graph(spark, sf_dir).withColumn("r", F.lit(0).cast("long"))


def _metric(name: str, compat: bool = False):
    def call(spark, sf_dir):
        values = K.global_metrics(_one(spark, sf_dir), NODES, compat)
        return values.where(F.col("metric") == name).select(F.round("value", 6).alias(name))

    return call


def _paths(spark, sf_dir):
    import pandas as pd

    def run_one(pdf):
        far = K.shortest(K.matrix(pdf, NODES))
        return pd.DataFrame([(i, j, round(float(far[i, j]), 6)) for i in range(NODES) for j in range(NODES) if i < j and far[i, j] < float("inf")], columns=["i", "j", "d"])

    return _one(spark, sf_dir).groupBy("r").applyInPandas(run_one, "i int, j int, d double")


def _kernels() -> dict[str, Callable]:
    cohort = lambda s, d: _views(s, d, views.subject_edges())["subject_edges"]

    def louvain(s, d):
        return K.partitions(_samples(s, d), NODES)

    def consensus(s, d):
        return K.consensus(G.coassignment(K.partitions(_samples(s, d), NODES).select("r", "node", "community")), NODES)

    def metrics_ci(s, d):
        return K.metric_summary(K.global_metrics(_samples(s, d), NODES), ["metric"])

    def plain_metrics(s, d):
        """The metrics that no random partition enters."""
        made = K.global_metrics(_samples(s, d), NODES).where("metric <> 'modularity'")
        return K.metric_summary(made, ["metric"]).select("metric", *[F.round(c, 5).alias(c) for c in ("mean", "std", "ci_low", "ci_high")])

    def nodal_ci(s, d):
        made = K.nodal_metrics(_samples(s, d, 10), NODES).selectExpr("node", "stack(3, 'strength', strength, 'local_efficiency', local_efficiency, 'betweenness', betweenness) AS (metric, value)")
        return K.metric_summary(made, ["metric", "node"]).select("metric", "node", *[F.round(c, 5).alias(c) for c in ("mean", "std", "ci_low", "ci_high")])

    def communicability(s, d):
        made = K.metric_summary(K.communicability_cells(_samples(s, d), NODES), ["i", "j"])
        return made.select("i", "j", *[F.round(c, 5).alias(c) for c in ("mean", "std", "ci_low", "ci_high")])

    def communicability_nodes(s, d):
        made = K.communicability_nodes(K.communicability_cells(_samples(s, d), NODES))
        return made.select("node", *[F.round(c, 5).alias(c) for c in ("mean", "std", "ci_low", "ci_high", "subgraph_mean", "subgraph_std")])

    def communicability_plot(s, d):
        mean = K.metric_summary(K.communicability_cells(_samples(s, d), NODES), ["i", "j"]).select("i", "j", F.col("mean").alias("value"))
        return run(s, _pick(P.communicability_steps("{cells}"), "i j place", "value", 5), cells=mean)

    def regions(s, d):
        return [r["community"] for r in _table(s, d, "nation").orderBy("n_nationkey").select(F.col("n_regionkey").alias("community")).collect()]  # a row a parcel

    def hub_bootstrap(s, d):
        made = K.hub_summary(K.hub_samples(_samples(s, d), NODES, regions(s, d)))
        return made.select("node", "hub_class", *[F.round(c, 5).alias(c) for c in ("hub_probability", "stability", "z_mean", "z_std", "participation_mean", "participation_std", "participation_low", "participation_high")])

    def hub_betweenness(s, d):
        made = K.hub_summary(K.hub_samples(_samples(s, d, 10), NODES))
        return made.select("node", *[F.round(c, 5).alias(c) for c in ("hub_probability", "betweenness_mean", "betweenness_std", "betweenness_low", "betweenness_high")])

    def rich_club_bootstrap(s, d):
        made = K.rich_club_summary(K.rich_club_normalized(_strong(_samples(s, d)), NODES, 0))
        return made.select("k", "replicates", *[F.round(c, 5).alias(c) for c in ("phi_mean", "phi_std", "phi_low", "phi_high")])

    def rich_club_members(s, d):
        made = _strong(_samples(s, d))
        low, high = K.degree_range(made, NODES)
        return K.rich_club_members(made, NODES, low + (high - low + 1) // 2)

    def rich_club_summary(s, d):
        return K.rich_club_summary(K.rich_club_normalized(_strong(_samples(s, d, 5)), NODES, 5))

    def robust_communities(s, d):
        made = _samples(s, d, 10)
        stats = made.groupBy("i", "j").agg((F.count_if(F.col("w") > 0) / F.lit(10)).alias("p_nonzero"), (F.stddev_pop("w") / F.avg("w")).alias("cv"))
        return K.community_detection(made, NODES, 10, E.classify_edges(stats))[1]

    def plot_metrics(s, d):
        values = K.global_metrics(_samples(s, d), NODES).where("metric <> 'modularity'")
        made = P.metric_intervals(values, K.metric_summary(values, ["metric"]))
        return made.select("metric", "r", *[F.round(c, 5).alias(c) for c in ("value", "mean", "ci_low", "ci_high")])

    def rewired_degrees(s, d):
        """Node degrees and the whole weight of rewired graphs, which swaps leave as they are."""
        made = K.rewired(_strong(_one(s, d)), NODES, 3)
        ends = made.select("null_id", F.col("i").alias("node"), "w").unionByName(made.select("null_id", F.col("j").alias("node"), "w"))
        whole = made.groupBy("null_id").agg(F.round(F.sum("w"), 5).alias("weight"))
        return ends.groupBy("null_id", "node").agg(F.count("*").alias("degree")).join(whole, "null_id")

    def small_worlds(s, d):
        return K.small_world_propensity(_strong(_samples(s, d, 4)), NODES, 5, 5)

    def stream(s, d):
        return running.running_statistics(_table(s, d, "events"), "event_type", "value").select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "var", "std", "p_nonzero")])

    def text_matrix(s, d):
        nodes = _views(s, d, views.nodes())["nodes"]
        return files.matrix_rows(_graph(s, d), nodes, "w", "%.2f")

    def pls(s, d):
        e = cohort(s, d)
        subjects = e.select("subject").distinct()
        grid = e.select("i", "j").distinct().crossJoin(subjects)  # edges by subjects: both bounded by the cohort
        x = grid.join(e, ["subject", "i", "j"], "left").select("subject", (F.col("i") * NODES + F.col("j")).alias("feature"), F.coalesce("w", F.lit(0.0)).alias("x"))
        b = _views(s, d, views.behavior())["behavior"]
        y = b.select("subject", F.lit(0).alias("var"), F.col("value").alias("y")).unionByName(b.select("subject", F.lit(1).alias("var"), F.sqrt(F.abs("value")).alias("y")))
        return x, y

    return {
        "louvain": louvain,
        "community_consensus": consensus,
        "graph_metrics_ci": metrics_ci,
        "nodal_metrics_ci": nodal_ci,
        "communicability": communicability,
        "betweenness": lambda s, d: K.nodal_metrics(_one(s, d), NODES).select("node", F.round("betweenness", 6).alias("betweenness")),
        "rewire_degrees": rewired_degrees,
        "rich_club_bootstrap": rich_club_bootstrap,
        "rich_club_members": rich_club_members,
        "rich_club_normalized": rich_club_summary,
        "plot_rich_club": lambda s, d: P.rich_club_curves(rich_club_summary(s, d)),
        "small_world": small_worlds,
        "small_world_summary": lambda s, d: K.small_world_summary(small_worlds(s, d)),
        "hub_bootstrap": hub_bootstrap,
        "hub_betweenness": hub_betweenness,
        "nbs_fwer": lambda s, d: K.nbs(cohort(s, d), NODES, 1.0, 100).select("component", "size", F.round("p", 6).alias("p")),
        "nbs_edges": lambda s, d: K.nbs_edges(cohort(s, d), NODES, 1.0, 100).select("i", "j", F.round("t", 5).alias("t"), "component", "size", F.round("p", 6).alias("p"), "significant"),
        "tfnbs": lambda s, d: K.tfnbs_tested(saved(cohort(s, d), "cohort", tidy=True), NODES).select("i", "j", F.round("score", 4).alias("score"), F.round("p", 6).alias("p"), "significant"),
        "local_efficiency": lambda s, d: K.nodal_metrics(_one(s, d), NODES).select("node", F.round("local_efficiency", 6).alias("local_efficiency")),
        "ring_lattice": _ring,
        "communicability_nodes": communicability_nodes,
        "plot_communicability": communicability_plot,
        "community_spread": lambda s, d: P.community_spread(K.partitions(_samples(s, d), NODES)),
        "robust_communities": robust_communities,
        "plot_metrics": plot_metrics,
        "graph_metrics_plain": plain_metrics,
        "pls_bootstrap": lambda s, d: K.pls_tables(*pls(s, d), 2, 100, 0)[0].select("component", *[F.round(c, 4).alias(c) for c in ("singular_value", "explained", "p")]),
        "pls_reliable": lambda s, d: P.reliable_cells(K.pls_tables(*pls(s, d), 2, 5, 100)[1]),
        "shortest_paths": _paths,
        "global_efficiency": _metric("global_efficiency"),
        "global_efficiency_compat": _metric("global_efficiency", True),
        "char_path_length": _metric("path_length"),
        "running_statistics": stream,
        "text_matrix": text_matrix,
        "voxel_connectome": _voxel,
    }


def _ring(spark, sf_dir):
    import pandas as pd

    def make(pdf):
        m = K.ring_lattice(K.matrix(pdf, NODES), K.rng("lattice", 42))
        return pd.DataFrame({"node": np.arange(NODES, dtype=np.int32), "degree": (m > 0).sum(axis=1), "near": [int(m[k, (k + 1) % NODES] > 0) for k in range(NODES)]})

    return _strong(_one(spark, sf_dir)).groupBy("r").applyInPandas(make, "node int, degree long, near int")


def _voxel(spark, sf_dir):
    import pandas as pd

    signals = _views(spark, sf_dir, _signals(Spark))["signals"]
    fields = run(spark, V.wild_steps(Spark, 3, *V.gradients()), signals=signals)

    def track(r, pdf):
        # a stub: voxels are dealt to five parcels, neighbours on the ring share the mean trace of their tensors
        trace = pdf[pdf["c"] <= 3].groupby("voxel")["value"].sum().abs()
        mean = trace.groupby(trace.index % 5).mean()
        return pd.DataFrame({"i": range(4), "j": range(1, 5), "w": [float(mean.get(k, 0) + mean.get(k + 1, 0)) for k in range(4)]})

    made = V.voxel_connectome(fields, track, 5)
    return made.select("i", "j", *[F.round(c, 7).alias(c) for c in ("mean", "std", "ci_low", "ci_high", "p_nonzero")])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(*plan) for name, plan in _plans().items()} | _kernels()


def oracle_sql() -> dict[str, str]:
    return oracles.sql(NODES, B)
