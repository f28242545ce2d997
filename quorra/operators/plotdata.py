"""Quantities behind the figures, as tables; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorra.plans.sql import Spark, Steps, run


def uncertainty_steps(dialect, table: str) -> Steps:
    return [
        ("logs", f"SELECT log10(mean + 1e-10) AS lm, log10(std + 1e-10) AS ls, cv, mean FROM {table}"),
        ("out", f"SELECT {dialect.quantile('CASE WHEN lm > -9 THEN lm END', 0.05)} AS mean_low, {dialect.quantile('CASE WHEN lm > -9 THEN lm END', 0.95)} AS mean_high, {dialect.quantile('CASE WHEN ls > -9 THEN ls END', 0.05)} AS std_low, {dialect.quantile('CASE WHEN ls > -9 THEN ls END', 0.95)} AS std_high, {dialect.quantile('CASE WHEN cv > 0 THEN cv END', 0.95)} AS cv_high, avg(CASE WHEN mean > 0 THEN cv END) AS mean_cv FROM logs"),
    ]


def ordered_nodes_steps() -> Steps:
    """Nodes sorted by community, with the places where a new one begins."""
    return [
        ("sorted", "SELECT node, community, row_number() OVER (ORDER BY community, node) - 1 AS place FROM {partition}"),
        ("out", "SELECT node, community, place, CASE WHEN community <> lag(community) OVER (ORDER BY place) THEN 1 ELSE 0 END AS boundary FROM sorted"),
    ]


def line_steps(table: str, x: str, y: str) -> Steps:
    """line(n, r, slope, intercept) of y on x over the rows that have both; null where a deviation is zero."""
    return [
        ("line_sums", f"SELECT count(*) AS n, covar_pop({x}, {y}) AS c, var_pop({x}) AS vx, var_pop({y}) AS vy, avg({x}) AS mx, avg({y}) AS my FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL AND NOT isnan({x}) AND NOT isnan({y})"),
        ("line", "SELECT n, CASE WHEN vx > 0 AND vy > 0 THEN c / sqrt(vx * vy) END AS r, CASE WHEN n > 2 AND vx > 0 THEN c / vx END AS slope, CASE WHEN n > 2 AND vx > 0 THEN my - c / vx * mx END AS intercept FROM line_sums"),
    ]


def clinical_steps(top: int = 5, table: str = "{scores}") -> Steps:
    """Correlation and line of a node's stability with a clinical score, and the nodes of extreme stability."""
    return [
        *line_steps(table, "stability", "score"),
        ("ranked", f"SELECT node, stability, score, row_number() OVER (ORDER BY stability DESC, node) AS hi, row_number() OVER (ORDER BY stability, node) AS lo FROM {table} WHERE stability IS NOT NULL AND score IS NOT NULL AND NOT isnan(stability) AND NOT isnan(score)"),
        ("out", f"SELECT node, stability, score, CASE WHEN hi <= {top} THEN 'top' ELSE 'bottom' END AS side, r, slope, intercept FROM ranked CROSS JOIN line WHERE hi <= {top} OR lo <= {top}"),
    ]


def nbs_steps(dialect, table: str, threshold: float) -> Steps:
    return [("out", f"SELECT {dialect.quantile('CASE WHEN t <> 0 THEN abs(t) END', 0.95)} AS t_high, sum(CASE WHEN abs(t) > {threshold} THEN 1 ELSE 0 END) AS n_beyond FROM {table}")]


def hub_order_steps(table: str) -> Steps:
    return [("out", f"SELECT node, strength, participation, z, hub_class, row_number() OVER (ORDER BY strength DESC, node) AS by_strength, row_number() OVER (ORDER BY round(participation, 9) DESC, node) AS by_participation, row_number() OVER (ORDER BY hub_class DESC, strength DESC, node) AS by_class FROM {table}")]


def prediction_steps(table: str) -> Steps:
    """Correlation and line of predicted on actual values, mean width of the intervals."""
    return [*line_steps(table, "actual", "predicted"), ("out", f"SELECT max(r) AS r, max(slope) AS slope, max(intercept) AS intercept, avg(ci_high - ci_low) AS width FROM {table} CROSS JOIN line")]


def tract_bands_steps(bands: str, compared: str) -> Steps:
    """Bands of a profile with the points at which groups differ: bands(pt, mean, ci_low, ci_high), compared(pt, t, p_corrected)."""
    return [("out", f"SELECT b.pt, mean, ci_low, ci_high, t, CASE WHEN p_corrected < 0.05 THEN 1 ELSE 0 END AS significant FROM {bands} b JOIN {compared} c ON c.pt = b.pt")]


def communicability_steps(table: str) -> Steps:
    """(i, j, value, place) of table(i, j, value): log10 cells, and the diagonal (subgraph centrality) in descending order."""
    return [("out", f"SELECT i, j, log10(value + 1e-10) AS value, CASE WHEN i = j THEN row_number() OVER (PARTITION BY CASE WHEN i = j THEN 1 ELSE 0 END ORDER BY round(value, 9) DESC, i) END AS place FROM {table}")]


def latent_variable_steps(scores: str) -> Steps:
    """Correlation of brain and behaviour scores."""
    return [*line_steps(scores, "brain", "behaviour"), ("out", "SELECT r, n FROM line")]


def metric_intervals(values: DataFrame, summary: DataFrame) -> DataFrame:
    """(metric, r, value, mean, ci_low, ci_high): every sample of a scalar metric beside its interval."""
    return values.join(summary.select("metric", "mean", "ci_low", "ci_high"), "metric").select("metric", "r", "value", "mean", "ci_low", "ci_high")


def rich_club_curves(summary: DataFrame) -> DataFrame:
    """(curve, k, mean, low, high) of kernels.rich_club_summary: both curves with their bands, in long form."""
    return summary.select(F.expr("stack(2, 'phi', phi_mean, phi_low, phi_high, 'phi_norm', norm_mean, norm_low, norm_high) AS (curve, mean, low, high)"), "k").select("curve", "k", "mean", "low", "high")


def reliable_cells(weights: DataFrame, show: int = 2) -> DataFrame:
    """(component, feature, ratio, reliable) of kernels.pls_weights for the first components: |ratio| above 2 is reliable."""
    return weights.where(F.col("component") < show).select("component", "feature", "ratio", (F.abs("ratio") > 2).alias("reliable"))


def community_spread(partitions: DataFrame) -> DataFrame:
    """(n_communities, runs, q_mean, q_std): how many runs found how many communities, and all runs' modularity."""
    each = partitions.groupBy("r").agg(F.countDistinct("community").alias("n_communities"), F.max("modularity").alias("q"))
    whole = each.agg(F.avg("q").alias("q_mean"), F.stddev_pop("q").alias("q_std"))
    return each.groupBy("n_communities").agg(F.count("*").alias("runs")).crossJoin(F.broadcast(whole))  # one row


def uncertainty(edge_stats: DataFrame) -> DataFrame:
    return run(edge_stats.sparkSession, uncertainty_steps(Spark, "{edge_stats}"), edge_stats=edge_stats)


def ordered_nodes(partition: DataFrame) -> DataFrame:
    return run(partition.sparkSession, ordered_nodes_steps(), partition=partition)


def clinical(scores: DataFrame, top: int = 5) -> DataFrame:
    """scores(node, stability, score); rows with a null or NaN in either are left out."""
    return run(scores.sparkSession, clinical_steps(top), scores=scores)


def clinical_correlation(scores: DataFrame) -> tuple[float | None, float]:
    """(r, two-sided p) of stability and score."""
    from quorra.functions.special import pearson_p_value

    row = run(scores.sparkSession, line_steps("{scores}", "stability", "score"), scores=scores).first()
    return row["r"], pearson_p_value(row["r"], row["n"]) if row["r"] is not None else 1.0
