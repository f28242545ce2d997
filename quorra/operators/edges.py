"""Graph building, bootstrap of streamlines, edge statistics, edge classes, backbone."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame

from quorra.operators.draws import multinomial
from quorra.plans.sql import Spark, Steps, run

#: Above so many replicates, intervals are mean +- z * std.
EXACT_LIMIT = 5000


def build_sc_steps() -> Steps:
    return [("sc", "SELECT least(a, b) AS i, greatest(a, b) AS j, sum(w) AS w FROM {streamlines} WHERE a <> b GROUP BY least(a, b), greatest(a, b)")]


def build_sc(streamlines: DataFrame) -> DataFrame:
    """(i, j, w) of streamlines(sid, a, b, w): undirected sums, i < j, self-loops dropped."""
    return run(streamlines.sparkSession, build_sc_steps(), streamlines=streamlines)


def bootstrap_steps(dialect, replicates: int, seed: int = 42, method: str = "multinomial") -> Steps:
    """edge_samples(r, i, j, w): weights of every resample.

    multinomial draws as many rows as there are, with replacement; {sampled} holds them, made by draws.multinomial.
    poisson gives each row a count of its own (inverse CDF of a hashed uniform): no row numbers, no join, any size; a
    resample's size then varies.
    """
    if method == "poisson":
        u = f"(({dialect.hashed(seed, 'r', 'sid')} + 0.5) / 4294967296.0)"
        steps, total, term = [], 0.0, 0.36787944117144233
        for k in range(13):
            total += term
            steps.append(f"(CASE WHEN {{u}} > {total!r} THEN 1 ELSE 0 END)")
            term /= k + 1
        count = " + ".join(s.replace("{u}", "u") for s in steps)
        return [
            ("picked", f"SELECT r, a, b, w, {u} AS u FROM {{streamlines}} CROSS JOIN {dialect.series(replicates, 'r')} x WHERE a <> b"),
            ("edge_samples", f"SELECT r, least(a, b) AS i, greatest(a, b) AS j, sum(w * ({count})) AS w FROM picked WHERE u > 0.36787944117144233 GROUP BY r, least(a, b), greatest(a, b)"),
        ]
    return [("edge_samples", "SELECT r, i, j, w FROM {sampled} WHERE r >= 0")]


def edge_stats_steps(dialect, replicates: int, ci: float = 0.95, unit: float = 100.0, seed: int = 42, method: str = "multinomial", interval: str = "auto") -> Steps:
    """edge_stats: absent edges count as zero in every replicate (the observed edges are the candidates).

    interval: percentile, normal, or auto (normal above EXACT_LIMIT replicates).
    """
    low, high = (1 - ci) / 2, (1 + ci) / 2
    if interval == "normal" or (interval == "auto" and replicates > EXACT_LIMIT):
        z = NormalDist().inv_cdf(high)
        bounds = f"greatest(avg(w) - {z!r} * stddev_pop(w), 0.0) AS ci_low, avg(w) + {z!r} * stddev_pop(w) AS ci_high"
    else:
        bounds = f"{dialect.quantile('w', low)} AS ci_low, {dialect.quantile('w', high)} AS ci_high"
    seen = "SELECT least(a, b) AS i, greatest(a, b) AS j, sum(w) AS w FROM {streamlines} WHERE a <> b GROUP BY least(a, b), greatest(a, b)" if method == "poisson" else "SELECT i, j, w FROM {sampled} WHERE r < 0"
    return [
        *bootstrap_steps(dialect, replicates, seed, method),
        ("observed", f"SELECT i, j, w / cast({unit} AS double) AS observed FROM ({seen}) q"),
        ("dense", f"SELECT o.i, o.j, o.observed, coalesce(e.w, 0) / cast({unit} AS double) AS w FROM observed o CROSS JOIN {dialect.series(replicates, 'r')} x LEFT JOIN edge_samples e ON e.r = x.r AND e.i = o.i AND e.j = o.j"),
        ("raw", f"SELECT i, j, max(observed) AS observed, avg(w) AS mean, stddev_pop(w) AS std, {bounds}, {dialect.quantile('w', 0.5)} AS median, {dialect.quantile('w', 0.75)} - {dialect.quantile('w', 0.25)} AS iqr, cast(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS double) / {replicates} AS p_nonzero FROM dense GROUP BY i, j"),
        ("edge_stats", "SELECT i, j, observed, mean, std, CASE WHEN mean > 0 THEN std / mean ELSE 0.0 END AS cv, ci_low, ci_high, median, iqr, p_nonzero FROM raw"),
    ]


def bootstrap_edge_stats(streamlines: DataFrame, n_bootstrap: int = 1000, ci_level: float = 0.95, seed: int = 42, method: str = "multinomial", unit: float = 1.0, interval: str = "auto") -> DataFrame:
    """One row an observed edge: observed, mean, std (population), cv, percentile interval, median, iqr, p_nonzero."""
    return run(streamlines.sparkSession, edge_stats_steps(Spark, n_bootstrap, ci_level, unit, seed, method, interval), **_drawn(streamlines, n_bootstrap, seed, method))


def bootstrap_samples(streamlines: DataFrame, n_bootstrap: int, seed: int = 42, method: str = "multinomial") -> DataFrame:
    """(r, i, j, w): the resampled graphs themselves."""
    return run(streamlines.sparkSession, bootstrap_steps(Spark, n_bootstrap, seed, method), **_drawn(streamlines, n_bootstrap, seed, method))


def _drawn(streamlines: DataFrame, replicates: int, seed: int, method: str) -> dict[str, DataFrame]:
    """The input of the steps by its name."""
    return {"streamlines": streamlines} if method == "poisson" else {"sampled": multinomial(streamlines, replicates, seed)}


def classes_steps(table: str, robust: float = 0.95, fragile: tuple[float, float] = (0.05, 0.5), cv: float = 0.5) -> Steps:
    return [("classes", f"SELECT i, j, p_nonzero, cv, CASE WHEN p_nonzero >= {robust} AND cv < {cv} THEN 4 WHEN p_nonzero >= 0.5 THEN 3 WHEN p_nonzero >= {fragile[0]} AND p_nonzero < {fragile[1]} THEN 2 WHEN p_nonzero > 0 AND p_nonzero < {fragile[0]} THEN 1 ELSE 0 END AS label FROM {table}")]


def classify_edges(edge_stats: DataFrame, robust_threshold: float = 0.95, fragile_range: tuple[float, float] = (0.05, 0.5), cv_threshold: float = 0.5) -> DataFrame:
    """(i, j, p_nonzero, cv, label): 4 robust, 3 present, 2 fragile, 1 spurious, 0 absent."""
    return run(edge_stats.sparkSession, classes_steps("{edge_stats}", robust_threshold, fragile_range, cv_threshold), edge_stats=edge_stats)


def class_counts_steps(table: str, n_nodes: str) -> Steps:
    return [("class_counts", f"SELECT label, n + CASE WHEN label = 0 THEN {n_nodes} * ({n_nodes} - 1) / 2 - (SELECT count(*) FROM {table}) ELSE 0 END AS n FROM (SELECT l.label, cast(count(c.label) AS double) AS n FROM (SELECT 0 AS label UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) l LEFT JOIN {table} c ON c.label = l.label GROUP BY l.label) q")]


def prevalence_steps(table: str = "{subject_edges}") -> Steps:
    """edge_stats over subjects as replicates, zeros included."""
    return [
        ("n_subjects", f"SELECT count(DISTINCT subject) AS n FROM {table}"),
        ("sums", f"SELECT i, j, sum(w) AS s, sum(w * w) AS q, cast(count(*) AS double) AS k FROM {table} WHERE w > 0 GROUP BY i, j"),
        ("prevalence", "SELECT i, j, k / n AS p_nonzero, s / n AS mean, CASE WHEN s > 0 THEN round(sqrt(greatest(q / n - (s / n) * (s / n), 0.0)) / (s / n), 6) ELSE 0.0 END AS cv FROM sums CROSS JOIN n_subjects"),
    ]


def disparity_steps(alpha: float = 0.05) -> Steps:
    return [
        ("ends", "SELECT i AS node, i, j, w FROM {edges} UNION ALL SELECT j AS node, i, j, w FROM {edges}"),
        ("scored", "SELECT node, i, j, w, sum(w) OVER (PARTITION BY node) AS s, count(*) OVER (PARTITION BY node) AS k FROM ends WHERE w > 0"),
        ("backbone", f"SELECT i, j, max(w) AS w, max(CASE WHEN k >= 2 AND power(1 - w / s, k - 1) < {alpha} THEN 1 ELSE 0 END) AS kept FROM scored GROUP BY i, j"),
    ]


def disparity_filter(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(i, j, w, kept): kept is 1 if the edge is significant from either of its ends; ends of degree 1 never vote."""
    return run(edges.sparkSession, disparity_steps(alpha), edges=edges)


def disparity_summary_steps(alpha: float = 0.05) -> Steps:
    """(n_retained, n_total, weight_retained): what the backbone keeps; 0 of no weight."""
    return [*disparity_steps(alpha), ("out", "SELECT cast(sum(kept) AS bigint) AS n_retained, count(*) AS n_total, CASE WHEN sum(w) > 0 THEN sum(w * kept) / sum(w) ELSE 0.0 END AS weight_retained FROM backbone")]


def disparity_summary(edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    return run(edges.sparkSession, disparity_summary_steps(alpha), edges=edges)


def parametric_steps(dialect, replicates: int, seed: int = 42, table: str = "{edge_stats}") -> Steps:
    """(r, i, j, w) from edge statistics: max(0, mean + std * (z1 + z2) / 2) with two normal draws (Box and Muller) for each edge and replicate."""
    u, v = (f"(({dialect.hashed(seed + k, 'r', 'i', 'j')} + 0.5) / 4294967296.0)" for k in (0, 1))
    return [
        ("uniform", f"SELECT r, i, j, mean, std, {u} AS u, {v} AS v FROM {table} CROSS JOIN {dialect.series(replicates, 'r')} x"),
        ("out", f"SELECT r, i, j, greatest(0.0, mean + std * sqrt(-2 * ln(u)) * (cos({6.283185307179586!r} * v) + sin({6.283185307179586!r} * v)) / 2) AS w FROM uniform"),
    ]


def parametric_samples(edge_stats: DataFrame, n_samples: int, seed: int = 42) -> DataFrame:
    """Samples for results that kept none; the two normals are averaged, as for a matrix made symmetric."""
    return run(edge_stats.sparkSession, parametric_steps(Spark, n_samples, seed), edge_stats=edge_stats)


def samples_of(edge_stats: DataFrame, n_samples: int, stored: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """The first n_samples stored replicates if there are any, parametric ones otherwise."""
    return stored.where(f"r < {int(n_samples)}") if stored is not None else parametric_samples(edge_stats, n_samples, seed)


def expand_steps(dialect, factor: int = 100, seed: int = 42) -> Steps:
    u = f"(({dialect.hashed(seed, 'i', 'j', 'k')} + 0.5) / 4294967296.0)"
    return [
        ("sized", f"SELECT i, j, w, greatest(1, cast(floor({factor} * w / max(w) OVER ()) AS int)) AS n FROM {{edges}} WHERE w > 0"),
        ("slots", f"SELECT i, j, w, k, -ln({u}) AS x FROM sized JOIN {dialect.series(factor, 'k')} s ON k < n"),
        ("streamlines_made", "SELECT i AS a, j AS b, k, w * x / sum(x) OVER (PARTITION BY i, j) AS weight FROM slots"),
    ]


def assignments_from_sc(edges: DataFrame, expand_factor: int = 100, seed: int = 42) -> DataFrame:
    """(a, b, k, weight): streamlines in number proportional to the edge's weight, exponential weights that sum to it."""
    return run(edges.sparkSession, expand_steps(Spark, expand_factor, seed), edges=edges)
