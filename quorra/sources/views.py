"""The domain's tables as views over trade data: nations are parcels, order lines are weighted streamlines.

Orders meet their customers before the lines do, so that the lines, the largest table by far, are dealt once.
"""

from __future__ import annotations

from quorra.plans.sql import Steps

_LINES = """SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b,
  cast(round(l_extendedprice * 100) AS bigint) AS w, cast(c_custkey % 24 AS int) AS subject, c_acctbal
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN (
  SELECT o_orderkey, c_custkey, c_nationkey, c_acctbal FROM {orders} JOIN {customer} ON o_custkey = c_custkey) o ON l_orderkey = o_orderkey
WHERE c_nationkey <> s_nationkey"""
_SPARSE = " AND l_quantity >= 49 AND l_returnflag = 'R'"
_TIERED = " AND ((c_nationkey + s_nationkey) % 3 = 0 OR ((c_nationkey + s_nationkey) % 3 = 1 AND l_quantity >= 45) OR ((c_nationkey + s_nationkey) % 3 = 2 AND l_quantity >= 50 AND l_returnflag = 'R'))"


_KINDS = {"dense": "", "sparse": _SPARSE, "tiered": _TIERED}


def lines(kind: str = "dense") -> Steps:
    """streamlines(a, b, w) without numbers: all that sums need."""
    return [("streamlines", f"SELECT a, b, w FROM ({_LINES}{_KINDS[kind]}) q")]


def streamlines(kind: str = "dense", buckets: int = 64) -> Steps:
    """streamlines(sid, a, b, w): a < b, w in hundredths; equal rows are interchangeable, so sid is well defined.

    Numbers run from 0 without gaps: rows are ranked within (a, b, a bucket of w), and the counts of these groups, a
    small table, give each its first number. dense is every line; sparse and tiered leave edges of all classes and
    serve the queries whose result is classes.
    """
    return [
        ("bucketed", f"SELECT a, b, w, w % {buckets} AS u FROM ({_LINES}{_KINDS[kind]}) q"),
        ("groups", "SELECT a AS ga, b AS gb, u AS gu, count(*) AS n FROM bucketed GROUP BY a, b, u"),
        ("starts", "SELECT ga, gb, gu, coalesce(sum(n) OVER (ORDER BY ga, gb, gu ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM groups"),
        ("streamlines", "SELECT cast(o + row_number() OVER (PARTITION BY a, b, u ORDER BY w) - 1 AS bigint) AS sid, a, b, w FROM bucketed JOIN starts ON ga = a AND gb = b AND gu = u"),
    ]


def subject_lines() -> Steps:
    """subject_lines(sid, subject, grp, a, b, w): sid tells the lines of a subject apart; equal lines are interchangeable."""
    return [
        ("numbered_lines", f"SELECT subject, a, b, w, row_number() OVER (PARTITION BY subject, a, b ORDER BY w) AS nth FROM ({_LINES}) q"),
        ("subject_lines", "SELECT concat_ws('-', cast(subject AS string), cast(a AS string), cast(b AS string), cast(nth AS string)) AS sid, subject, CASE WHEN subject < 12 THEN 1 ELSE 2 END AS grp, a, b, cast(w * (CASE WHEN subject < 12 THEN 1.0 ELSE 0.7 END) AS double) AS w FROM numbered_lines"),
    ]


def edges() -> Steps:
    """edges(i, j, w): the observed graph, i < j, weights in units of a million hundredths."""
    return [("edges", f"SELECT a AS i, b AS j, sum(w) / 1e6 AS w FROM ({_LINES}) q GROUP BY a, b")]


def strong_edges() -> Steps:
    """edges whose weight is above the mean of all: a graph with gaps, made of every line."""
    return [("every_edge", edges()[0][1]), ("edges", "SELECT i, j, w FROM (SELECT *, avg(w) OVER () AS mean FROM every_edge) q WHERE w > mean")]


def partition() -> Steps:
    return [("partition", "SELECT n_nationkey AS node, n_regionkey AS community FROM {nation}")]


def nodes() -> Steps:
    return [("nodes", "SELECT n_nationkey AS node FROM {nation}")]


def subject_edges(kind: str = "dense") -> Steps:
    """subject_edges(subject, grp, i, j, w): 24 subjects in two groups; the second group's weights are 0.7 of it."""
    return [("subject_edges", f"SELECT subject, CASE WHEN subject < 12 THEN 1 ELSE 2 END AS grp, a AS i, b AS j, sum(w) * (CASE WHEN subject < 12 THEN 10 ELSE 7 END) / 1e7 AS w FROM ({_LINES}{_KINDS[kind]}) q GROUP BY subject, a, b")]


def behavior() -> Steps:
    return [("behavior", "SELECT cast(c_custkey % 24 AS int) AS subject, round(avg(c_acctbal), 4) AS value FROM {customer} GROUP BY cast(c_custkey % 24 AS int)")]


def node_scores() -> Steps:
    """node_scores(node, score): a score of each parcel, here its customers' mean balance."""
    return [("node_scores", "SELECT c_nationkey AS node, avg(c_acctbal) AS score FROM {customer} GROUP BY c_nationkey")]


def profiles(dialect) -> Steps:
    return [("profiles", dialect.points("embedding", "vec_id AS sid, label", "sid, label", "{embeddings}"))]


def bundle_weights() -> Steps:
    """weights(sid, weight) of the lines behind the profiles."""
    return [("weights", "SELECT vec_id AS sid, 1.0 + vec_id % 3 AS weight FROM {embeddings}")]


def plane_points(dialect) -> Steps:
    """points(sid, pt, x, y, z): each profile as a line in a plane."""
    return [*profiles(dialect), ("points", "SELECT sid, pt, cast(pt AS double) AS x, v AS y, 0.0 AS z FROM profiles")]


def space_points(dialect) -> Steps:
    """points(sid, pt, x, y, z): consecutive triples of each vector as places, in millimetres."""
    axis = lambda k: f"max(CASE WHEN pt % 3 = {k} THEN 20 + 12 * v END)"
    return [*profiles(dialect), ("points", f"SELECT sid, cast(floor(pt / 3) AS int) AS pt, {axis(0)} AS x, {axis(1)} AS y, {axis(2)} AS z FROM profiles WHERE pt < 63 GROUP BY sid, cast(floor(pt / 3) AS int)")]


def volume(dialect, side: int = 20) -> Steps:
    """volume(i, j, k, v): a cube of cells."""
    return [("volume", f"SELECT cast(i AS int) AS i, cast(j AS int) AS j, cast(k AS int) AS k, ((i * 7 + j * 3 + k * 5) % 11) / 10.0 AS v FROM {dialect.series(side, 'i')} a CROSS JOIN {dialect.series(side, 'j')} b CROSS JOIN {dialect.series(side, 'k')} c")]
