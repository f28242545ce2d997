"""Graph metrics that are joins and aggregates. Edges are (i, j, w) with i < j; nodes is the full list of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quorra.plans.sql import Spark, Steps, run

ENDS = ("ends", "SELECT i AS node, j AS other, w FROM {edges} WHERE w > 0 UNION ALL SELECT j AS node, i AS other, w FROM {edges} WHERE w > 0")


def strength_steps() -> Steps:
    return [ENDS, ("strengths", "SELECT n.node, coalesce(sum(w), 0.0) AS strength, count(w) AS degree FROM {nodes} n LEFT JOIN ends e ON e.node = n.node GROUP BY n.node")]


def summary_steps() -> Steps:
    return [*strength_steps(), ("summary", "SELECT cast(sum(degree) AS double) / (count(*) * (count(*) - 1)) AS density, avg(strength) AS mean_strength, stddev_pop(strength) AS strength_std FROM strengths")]


def modularity_steps() -> Steps:
    return [
        ENDS,
        ("marked", "SELECT p.community AS c, q.community AS d, w FROM ends JOIN {partition} p ON p.node = ends.node JOIN {partition} q ON q.node = ends.other"),
        ("m2", "SELECT sum(w) AS m FROM ends"),
        ("per", "SELECT c, sum(CASE WHEN c = d THEN w ELSE 0.0 END) AS inside, sum(w) AS k FROM marked GROUP BY c"),
        ("q", "SELECT coalesce(sum(inside / m - (k / m) * (k / m)), 0.0) AS modularity FROM per CROSS JOIN m2"),
    ]


def triangle_steps() -> Steps:
    """Closed walks of length three by node, weights cubed-rooted; each triangle counts twice at each corner."""
    return [
        ENDS,
        ("closed", "SELECT x.node, 2 * sum(cbrt(x.w) * cbrt(y.w) * cbrt(z.w)) AS t FROM ends x JOIN ends y ON y.node = x.node AND x.other < y.other JOIN ends z ON z.node = x.other AND z.other = y.other GROUP BY x.node"),
        ("degrees", "SELECT node, cast(count(*) AS double) AS k FROM ends GROUP BY node"),
    ]


def transitivity_steps() -> Steps:
    return [*triangle_steps(), ("out", "SELECT CASE WHEN sum(k * (k - 1)) > 0 THEN coalesce(sum(t), 0.0) / sum(k * (k - 1)) ELSE 0.0 END AS transitivity FROM degrees LEFT JOIN closed ON closed.node = degrees.node")]


def clustering_steps() -> Steps:
    return [*triangle_steps(), ("out", "SELECT coalesce(avg(coalesce(t, 0.0) / (k * (k - 1))), 0.0) AS clustering FROM degrees LEFT JOIN closed ON closed.node = degrees.node WHERE k >= 2")]


def participation_steps() -> Steps:
    return [
        ENDS,
        ("by_module", "SELECT e.node, p.community, sum(w) AS w FROM ends e JOIN {partition} p ON p.node = e.other GROUP BY e.node, p.community"),
        ("shares", "SELECT node, w / sum(w) OVER (PARTITION BY node) AS x FROM by_module"),
        ("out", "SELECT n.node, 1 - coalesce(sum(x * x), 0.0) AS participation FROM {nodes} n LEFT JOIN shares s ON s.node = n.node GROUP BY n.node"),
    ]


def within_z_steps() -> Steps:
    return [
        ENDS,
        ("own", "SELECT p.node, p.community, coalesce(sum(CASE WHEN q.node IS NOT NULL THEN w END), 0.0) AS s FROM {partition} p LEFT JOIN ends e ON e.node = p.node LEFT JOIN {partition} q ON q.node = e.other AND q.community = p.community GROUP BY p.node, p.community"),
        ("moments", "SELECT node, s, avg(s) OVER (PARTITION BY community) AS m, stddev_pop(s) OVER (PARTITION BY community) AS d, count(*) OVER (PARTITION BY community) AS n FROM own"),
        ("out", "SELECT node, CASE WHEN n > 1 AND d > 1e-12 THEN (s - m) / d ELSE 0.0 END AS z FROM moments"),
    ]


def hub_steps(dialect, percentile: float = 80.0) -> Steps:
    p, z = participation_steps(), within_z_steps()
    return [
        *strength_steps(),
        *p[1:-1], ("part", p[-1][1]), *z[1:-1], ("inner_z", z[-1][1]),
        ("cut", f"SELECT {dialect.quantile('strength', percentile / 100)} AS c FROM strengths"),
        ("out", "SELECT s.node, s.strength, participation, z, CASE WHEN s.strength <= c THEN 0 WHEN participation < 0.3 THEN 1 WHEN participation < 0.75 THEN 2 ELSE 3 END AS hub_class FROM strengths s JOIN part ON part.node = s.node JOIN inner_z ON inner_z.node = s.node CROSS JOIN cut"),
    ]


def rich_club_steps(dialect, levels: int = 24) -> Steps:
    """Mean weight over all pairs of nodes with degree above k; fewer than two such nodes: 0."""
    return [
        *strength_steps(),
        ("ks", f"SELECT cast(k AS int) AS k FROM {dialect.series(levels, 'k')} s"),
        ("rich", "SELECT k, node FROM strengths JOIN ks ON degree > k"),
        ("sizes", "SELECT k, count(*) AS n FROM rich GROUP BY k"),
        ("inside", "SELECT a.k, sum(w) AS w FROM {edges} e JOIN rich a ON a.node = e.i JOIN rich b ON b.node = e.j AND b.k = a.k GROUP BY a.k"),
        ("out", "SELECT ks.k, coalesce(n, 0) AS n_rich, CASE WHEN n >= 2 THEN coalesce(w, 0.0) / (n * (n - 1) / 2.0) ELSE 0.0 END AS phi FROM ks LEFT JOIN sizes ON sizes.k = ks.k LEFT JOIN inside ON inside.k = ks.k"),
    ]


def coassignment_steps() -> Steps:
    """(i, j, p) of {partitions}(r, node, community): share of runs in which two nodes are together."""
    return [
        ("runs", "SELECT count(DISTINCT r) AS n FROM {partitions}"),
        ("out", "SELECT a.node AS i, b.node AS j, cast(count(*) AS double) / max(n) AS p FROM {partitions} a JOIN {partitions} b ON a.r = b.r AND a.community = b.community AND a.node < b.node CROSS JOIN runs GROUP BY a.node, b.node"),
    ]


def _api(steps):
    def call(edges: DataFrame, **inputs: DataFrame) -> DataFrame:
        return run(edges.sparkSession, steps(), edges=edges, **inputs)

    return call


node_strength = _api(strength_steps)
strength_summary = _api(summary_steps)
modularity = _api(modularity_steps)
transitivity = _api(transitivity_steps)
weighted_clustering = _api(clustering_steps)
participation = _api(participation_steps)
within_module_z = _api(within_z_steps)


def coassignment(partitions: DataFrame) -> DataFrame:
    return run(partitions.sparkSession, coassignment_steps(), partitions=partitions)


def hub_classes(edges: DataFrame, nodes: DataFrame, partition: DataFrame, percentile: float = 80.0) -> DataFrame:
    return run(edges.sparkSession, hub_steps(Spark, percentile), edges=edges, nodes=nodes, partition=partition)


def rich_club(edges: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """(k, n_rich, phi) for degrees 0 to levels - 1."""
    return run(edges.sparkSession, rich_club_steps(Spark, levels), edges=edges, nodes=nodes)
