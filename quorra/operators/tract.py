"""Profiles along a path: bootstrap, group comparison with corrected p-values, clusters, geometry, sampling of a volume."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from quorra.plans.sql import Spark, Steps, run, values


def tract_bootstrap_steps(dialect, replicates: int, seed: int = 42, ci: float = 0.95) -> Steps:
    """Weighted mean profiles of resampled lines: {profiles}(sid, pt, v), {weights}(sid, weight)."""
    low, high = (1 - ci) / 2, (1 + ci) / 2
    q = dialect.quantile
    return [
        ("lines", "SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT sid FROM {profiles}) q"),
        ("draws", f"SELECT r, {dialect.hashed(seed, 'r', 'k')} % n AS k, count(*) AS m FROM lines CROSS JOIN {dialect.series(replicates, 'r')} x GROUP BY 1, 2"),
        ("drawn", "SELECT r, l.sid, m * weight AS m FROM draws JOIN lines l ON l.k = draws.k JOIN {weights} w ON w.sid = l.sid"),
        ("means", "SELECT r, pt, sum(m * v) / sum(m) AS v FROM drawn JOIN {profiles} p ON p.sid = drawn.sid GROUP BY r, pt"),
        ("observed", "SELECT pt, sum(weight * v) / sum(weight) AS observed FROM {profiles} p JOIN {weights} w ON w.sid = p.sid GROUP BY pt"),
        ("bands", f"SELECT pt, avg(v) AS mean, stddev_pop(v) AS std, {q('v', low)} AS ci_low, {q('v', high)} AS ci_high, {q('v', 0.5)} AS median, {q('v', 0.25)} AS q25, {q('v', 0.75)} AS q75 FROM means GROUP BY pt"),
        ("out", "SELECT b.*, observed FROM bands b JOIN observed o ON o.pt = b.pt"),
    ]


def relabelled_tests_steps(dialect, permutations: int, group1: str, seed: int = 42) -> Steps:
    """tvals(perm, pt, diff, t, d): pooled t and Cohen's d at each point for every relabelling of the lines; perm 0 is the true one."""
    return [
        ("lines", f"SELECT DISTINCT sid, CASE WHEN {group1} THEN 1 ELSE 2 END AS grp FROM {{profiles}}"),
        ("counts", "SELECT cast(count(CASE WHEN grp = 1 THEN 1 END) AS double) AS n1, cast(count(CASE WHEN grp = 2 THEN 1 END) AS double) AS n2 FROM lines"),
        ("ranked", f"SELECT perm, sid, grp, row_number() OVER (PARTITION BY perm ORDER BY {dialect.hashed(seed, 'perm', 'sid')}, sid) AS rk FROM lines CROSS JOIN {dialect.series(permutations + 1, 'perm')} p"),
        ("first", "SELECT perm, sid FROM ranked CROSS JOIN counts WHERE (perm = 0 AND grp = 1) OR (perm > 0 AND rk <= n1)"),
        ("every", "SELECT pt, sum(v) AS s, sum(v * v) AS q FROM {profiles} GROUP BY pt"),
        ("some", "SELECT perm, pt, sum(v) AS s, sum(v * v) AS q FROM first JOIN {profiles} p ON p.sid = first.sid GROUP BY perm, pt"),
        ("moments", "SELECT perm, some.pt, n1, n2, some.s / n1 AS m1, (every.s - some.s) / n2 AS m2, greatest(some.q - some.s * some.s / n1, 0.0) + greatest(every.q - some.q - (every.s - some.s) * (every.s - some.s) / n2, 0.0) AS ss FROM some JOIN every ON every.pt = some.pt CROSS JOIN counts"),
        ("tvals", "SELECT perm, pt, m1 - m2 AS diff, CASE WHEN ss > 1e-18 THEN round((m1 - m2) / sqrt(ss / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 9) ELSE 0.0 END AS t, CASE WHEN ss > 1e-18 THEN (m1 - m2) / sqrt(ss / (n1 + n2 - 2)) ELSE 0.0 END AS d FROM moments"),
    ]


def clusters_steps(table: str, threshold: float = 2.0) -> Steps:
    """clusters(perm, first_pt, last_pt, extent, mass, peak) of table(perm, pt, t): maximal runs of |t| above the threshold.

    Signs may mix; peak is the t of largest |t|, the first of equals.
    """
    return [
        ("high", f"SELECT perm, pt, t, pt - row_number() OVER (PARTITION BY perm ORDER BY pt) AS island FROM {table} WHERE abs(t) > {threshold}"),
        ("placed", "SELECT *, row_number() OVER (PARTITION BY perm, island ORDER BY abs(t) DESC, pt) AS place FROM high"),
        ("clusters", "SELECT perm, min(pt) AS first_pt, max(pt) AS last_pt, count(*) AS extent, round(sum(abs(t)), 6) AS mass, max(CASE WHEN place = 1 THEN t END) AS peak FROM placed GROUP BY perm, island"),
    ]


def cluster_p_steps(permutations: int) -> Steps:
    """tested: the clusters of the true grouping with p, the share of relabellings whose largest mass is as large."""
    return [
        ("tops", "SELECT perm, max(mass) AS top FROM clusters WHERE perm > 0 GROUP BY perm"),
        ("tested", f"SELECT first_pt, last_pt, extent, mass, peak, cast(count(top) AS double) / {permutations} AS p FROM (SELECT * FROM clusters WHERE perm = 0) c LEFT JOIN tops ON top >= mass GROUP BY first_pt, last_pt, extent, mass, peak"),
    ]


def t_p_steps(dialect, table: str, degrees: int = 20_000, nodes: int = 2_000) -> Steps:
    """plain(pt, diff, t, d, p): two-sided p of t with whole degrees of freedom (n1 + n2 - 2), by its finite series.

    Above ``degrees``, where the series would have a term for every other line, the density is integrated by Simpson's
    rule instead; its constant there is the expansion of the gamma functions' ratio, exact to double precision.
    """
    factor = "(1 - 1 / (4 * v) + 1 / (32 * v * v) + 5 / (128 * v * v * v))"
    return [
        ("odds", f"SELECT k, exp(sum(CASE WHEN k = 0 THEN 0.0 ELSE ln((2 * k - 1.0) / (2 * k)) END) OVER (ORDER BY k)) AS c, exp(sum(CASE WHEN k = 0 THEN 0.0 ELSE ln(2.0 * k / (2 * k + 1)) END) OVER (ORDER BY k)) AS e FROM {dialect.series(degrees // 2 + 1, 'k')} s"),
        ("angles", f"SELECT pt, diff, t, d, n1 + n2 - 2 AS v, atan(abs(t) / sqrt(n1 + n2 - 2)) AS x, least(abs(t), 40.0) AS far FROM {table} CROSS JOIN counts WHERE perm = 0"),  # the density beyond 40 is 0 in a double
        ("sums", f"SELECT pt, sum(CASE WHEN v % 2 = 0 THEN c * power(cos(x), 2 * k) ELSE e * power(cos(x), 2 * k + 1) END) AS s FROM angles JOIN odds ON v <= {degrees} AND k < CASE WHEN v % 2 = 0 THEN v / 2 ELSE (v - 1) / 2 END GROUP BY pt"),
        ("areas", f"SELECT pt, max({factor}) * sum(CASE WHEN k IN (0, {nodes}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-(v + 1) / 2 * log1p(power(far * k / {nodes}, 2) / v))) * max(far) / {3 * nodes} / {(2 * np.pi) ** 0.5!r} AS s FROM angles CROSS JOIN {dialect.series(nodes + 1, 'k')} q WHERE v > {degrees} GROUP BY pt"),
        ("plain", f"SELECT a.pt, diff, t, d, greatest(0.0, 1 - CASE WHEN v > {degrees} THEN 2 * areas.s WHEN v % 2 = 0 THEN sin(x) * coalesce(sums.s, 0.0) ELSE 2 / {np.pi!r} * (x + sin(x) * coalesce(sums.s, 0.0)) END) AS p FROM angles a LEFT JOIN sums ON sums.pt = a.pt LEFT JOIN areas ON areas.pt = a.pt"),
    ]


def tract_compare_steps(dialect, permutations: int, correction: str = "cluster", threshold: float = 2.0, group1: str = "label < 5", seed: int = 42) -> Steps:
    """(pt, diff, t, d, p, p_corrected): cluster mass against relabellings, or fdr, or bonferroni over the points."""
    tested = relabelled_tests_steps(dialect, permutations if correction == "cluster" else 0, group1, seed) + t_p_steps(dialect, "tvals")
    if correction == "cluster":
        return [
            *tested,
            *clusters_steps("tvals", threshold),
            *cluster_p_steps(permutations),
            ("out", "SELECT pt, diff, t, d, plain.p, coalesce(tested.p, 1.0) AS p_corrected FROM plain LEFT JOIN tested ON pt BETWEEN first_pt AND last_pt AND tested.p < 0.05"),
        ]
    corrected = "least(1.0, min(p * n / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))" if correction == "fdr" else "least(1.0, p * n)"
    return [
        *tested,
        ("placed", "SELECT *, row_number() OVER (ORDER BY p, pt) AS rk, cast(count(*) OVER () AS double) AS n FROM plain"),
        ("out", f"SELECT pt, diff, t, d, p, {corrected} AS p_corrected FROM placed"),
    ]


def tract_clusters_steps(dialect, permutations: int, threshold: float = 2.0, group1: str = "label < 5", seed: int = 42) -> Steps:
    return [*relabelled_tests_steps(dialect, permutations, group1, seed), *clusters_steps("tvals", threshold), *cluster_p_steps(permutations)]


def bundle_stability_steps(dialect, replicates: int, seed: int = 42) -> Steps:
    """Mean number of draws of each line, averaged by bundle."""
    return [
        ("lines", "SELECT sid, label, row_number() OVER (ORDER BY sid) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT sid, label FROM {profiles}) q"),
        ("draws", f"SELECT {dialect.hashed(seed, 'r', 'k')} % n AS k, count(*) AS m FROM lines CROSS JOIN {dialect.series(replicates, 'r')} x GROUP BY 1"),
        ("out", f"SELECT label, cast(sum(coalesce(m, 0)) AS double) / {replicates} / count(*) AS stability, count(*) AS n_lines FROM lines LEFT JOIN draws ON draws.k = lines.k GROUP BY label"),
    ]


def resample_steps(dialect, points: int = 20) -> Steps:
    """resampled(sid, k, x, y, z): equidistant points along each line of {points}(sid, pt, x, y, z).

    Cumulative arc length, targets placed on their segments, linear interpolation. A line of length zero, or of
    one point, is its first point throughout.
    """
    moved = " + ".join(f"({c} - lag({c}) OVER w) * ({c} - lag({c}) OVER w)" for c in "xyz")
    return [
        ("steps", f"SELECT sid, pt, x, y, z, coalesce(sqrt({moved}), 0.0) AS step FROM {{points}} WINDOW w AS (PARTITION BY sid ORDER BY pt)"),
        ("arc", "SELECT sid, pt, x, y, z, round(sum(step) OVER (PARTITION BY sid ORDER BY pt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS s FROM steps"),
        ("segments", "SELECT sid, x, y, z, s, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2, row_number() OVER w AS nth, count(*) OVER (PARTITION BY sid) AS n, max(s) OVER (PARTITION BY sid) AS total FROM arc WINDOW w AS (PARTITION BY sid ORDER BY pt)"),
        ("targets", f"SELECT sid, cast(k AS int) AS k, round(total * k / {points - 1}.0, 9) AS target FROM (SELECT sid, max(s) AS total FROM arc GROUP BY sid) q CROSS JOIN {dialect.series(points, 'k')} t"),
        ("placed", "SELECT g.sid, k, x, y, z, x2, y2, z2, CASE WHEN total = 0 OR s2 - s < 1e-10 THEN 0.0 ELSE least(1.0, (target - s) / (s2 - s)) END AS f, total FROM targets t JOIN segments g ON g.sid = t.sid AND ((total > 0 AND ((s <= target AND target < s2) OR (nth = n - 1 AND target >= total))) OR (total = 0 AND nth = 1))"),
        ("resampled", "SELECT sid, k, " + ", ".join(f"CASE WHEN f = 0 THEN {c} ELSE {c} + f * ({c}2 - {c}) END AS {c}" for c in "xyz") + " FROM placed"),
    ]


def sampled_profile_steps(dialect, affine: np.ndarray, shape: tuple[int, int, int], points: int = 20) -> Steps:
    """tract_profiles(sid, pt, v): {volume}(i, j, k, v) along the resampled lines, by the eight cells around each point.

    affine takes cells to the lines' space; its inverse takes points to cells. Points outside take the nearest cell.
    """
    back = np.linalg.inv(affine)
    spot = [" + ".join(f"({float(back[r, c])!r}) * {'xyz'[c]}" for c in range(3)) + f" + ({float(back[r, 3])!r})" for r in range(3)]
    inside = ", ".join(f"least(greatest(round({e}, 9), 0.0), {n - 1}.0) AS {a}" for e, n, a in zip(spot, shape, "ijk", strict=True))
    corner = ", ".join(f"cast(least(floor({a}) + d{a}, {n - 1}) AS int) AS c{a}" for n, a in zip(shape, "ijk", strict=True))
    share = " * ".join(f"(CASE WHEN d{a} = 1 THEN {a} - floor({a}) ELSE 1 - ({a} - floor({a})) END)" for a in "ijk")
    return [
        *resample_steps(dialect, points),
        ("cells", f"SELECT sid, k AS pt, {inside} FROM resampled"),
        ("offsets", values([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], "di, dj, dk")),
        ("corners", f"SELECT sid, pt, {corner}, {share} AS part FROM cells CROSS JOIN offsets"),
        ("tract_profiles", "SELECT sid, pt, sum(part * v) AS v FROM corners JOIN {volume} q ON q.i = ci AND q.j = cj AND q.k = ck GROUP BY sid, pt"),
    ]


def profile_summary_steps(table: str) -> Steps:
    """(pt, mean, std, weighted_mean) of table(sid, pt, v) with {weights}(sid, weight)."""
    return [("summary", f"SELECT pt, avg(v) AS mean, stddev_pop(v) AS std, sum(v * weight) / sum(weight) AS weighted_mean FROM {table} p JOIN {{weights}} w ON w.sid = p.sid GROUP BY pt")]


def _weights(profiles: DataFrame, weights: DataFrame | None) -> DataFrame:
    return weights if weights is not None else profiles.selectExpr("sid", "1.0D AS weight").distinct()


def along_tract_bootstrap(profiles: DataFrame, weights: DataFrame | None = None, n_bootstrap: int = 1000, ci_level: float = 0.95, seed: int = 42) -> DataFrame:
    return run(profiles.sparkSession, tract_bootstrap_steps(Spark, n_bootstrap, seed, ci_level), profiles=profiles, weights=_weights(profiles, weights))


def compare_tract_profiles(profiles: DataFrame, n_permutations: int = 5000, correction: str = "cluster", cluster_threshold: float = 2.0, group1: str = "grp = 1", seed: int = 42) -> DataFrame:
    """profiles(sid, pt, v and what group1 reads)."""
    return run(profiles.sparkSession, tract_compare_steps(Spark, n_permutations, correction, cluster_threshold, group1, seed), profiles=profiles)


def tract_clusters(profiles: DataFrame, n_permutations: int = 5000, cluster_threshold: float = 2.0, group1: str = "grp = 1", seed: int = 42) -> DataFrame:
    return run(profiles.sparkSession, tract_clusters_steps(Spark, n_permutations, cluster_threshold, group1, seed), profiles=profiles)


def bundle_stability(profiles: DataFrame, n_bootstrap: int = 1000, seed: int = 42) -> DataFrame:
    return run(profiles.sparkSession, bundle_stability_steps(Spark, n_bootstrap, seed), profiles=profiles)


def resample_streamlines(points: DataFrame, n_points: int = 100) -> DataFrame:
    return run(points.sparkSession, resample_steps(Spark, n_points), points=points)


def tract_profile_from_streamlines(points: DataFrame, volume: DataFrame, affine: np.ndarray, shape: tuple[int, int, int], n_points: int = 100) -> DataFrame:
    return run(points.sparkSession, sampled_profile_steps(Spark, affine, shape, n_points), points=points, volume=volume)


def profile_summary(profiles: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    return run(profiles.sparkSession, profile_summary_steps("{profiles}"), profiles=profiles, weights=_weights(profiles, weights))
