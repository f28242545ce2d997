"""The queries' rows in DuckDB, written apart from the plans: dense matrices, lists and DuckDB's own statistics.

Only the draws are the same by need: the hash of (seed, replicate, row) that decides them, and the tables' roles.
"""

from __future__ import annotations

import numpy as np

from quorra.functions.special import critical_r
from quorra.operators import voxel

#: The roles of the tables: nations are parcels, order lines are streamlines.
LINES = """lines AS MATERIALIZED (
  SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, CAST(round(l_extendedprice * 100) AS BIGINT) AS w,
         CAST(c_custkey % 24 AS INT) AS subject, l_quantity AS q, l_returnflag AS f, (c_nationkey + s_nationkey) % 3 AS tier
  FROM lineitem, orders, customer, supplier
  WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey <> s_nationkey)"""
SPARSE = "q >= 49 AND f = 'R'"
TIERED = "(tier = 0 OR (tier = 1 AND q >= 45) OR (tier = 2 AND q >= 50 AND f = 'R'))"


def _hash(*parts: object) -> str:
    return "('0x' || left(md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 8))::bigint"


def _numbered(where: str = "true") -> str:
    return f"{LINES}, s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY a, b, w % 64, w) - 1 AS sid, a, b, w FROM lines WHERE {where})"


def _multinomial(b: int, where: str = "true") -> str:
    """x(r, a, b, w): resampled weights."""
    return f"""{_numbered(where)},
picks AS (SELECT r, {_hash(42, 'r', 'sid')} % (SELECT count(*) FROM s) AS pick FROM s, range({b}) t(r)),
x AS MATERIALIZED (SELECT r, a, b, sum(w) AS w FROM picks JOIN s ON sid = pick GROUP BY ALL)"""


def _poisson(b: int, source: str, keys: str = "") -> str:
    """x(r, a, b, w) with the inverse CDF of a Poisson variable of mean 1, from its cumulative table."""
    return f"""law AS (SELECT k, sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS upto FROM range(13) t(k)),
drawn AS (SELECT r, {keys} a, b, w, ({_hash(42, 'r', 'sid')} + 0.5) / 4294967296 AS u FROM {source}, range({b}) t(r)),
x AS MATERIALIZED (SELECT r, {keys} a, b, sum(w * (SELECT count(*) FROM law WHERE upto < u)) AS w FROM drawn WHERE u > exp(-1) GROUP BY r, {keys} a, b)"""


def _stats(b: int, normal: bool = False) -> str:
    """stats(i, j, ...) from s and x: every edge's weights as one list of b numbers."""
    if normal:
        low, high = "greatest(0, list_avg(l) - 1.959963984540054 * list_stddev_pop(l))", "list_avg(l) + 1.959963984540054 * list_stddev_pop(l)"
    else:
        low, high = "list_aggregate(l, 'quantile_cont', 0.025)", "list_aggregate(l, 'quantile_cont', 0.975)"
    return f"""e AS (SELECT a, b, sum(w) / 100.0 AS observed FROM s GROUP BY ALL),
l AS (SELECT e.a, e.b, observed, list(CAST(x.w / 100.0 AS DOUBLE)) FILTER (x.w IS NOT NULL) AS given FROM e LEFT JOIN x ON x.a = e.a AND x.b = e.b GROUP BY ALL),
p AS (SELECT a, b, observed, list_concat(coalesce(given, []), [0.0::DOUBLE for z in range({b} - coalesce(len(given), 0))]) AS l FROM l),
stats AS MATERIALIZED (SELECT a AS i, b AS j, observed, list_avg(l) AS mean, list_stddev_pop(l) AS std, CASE WHEN list_avg(l) > 0 THEN list_stddev_pop(l) / list_avg(l) ELSE 0 END AS cv,
  {low} AS ci_low, {high} AS ci_high, list_aggregate(l, 'quantile_cont', 0.5) AS median,
  list_aggregate(l, 'quantile_cont', 0.75) - list_aggregate(l, 'quantile_cont', 0.25) AS iqr, len([z for z in l if z > 0]) / {b}.0 AS p_nonzero FROM p)"""


def _rounded(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in names.split())


def _matrix(n: int, edges: str = "SELECT a AS i, b AS j, sum(w) / 1e6 AS w FROM lines GROUP BY ALL") -> str:
    """m(i, j, w): the whole symmetric matrix, zeros included; c(node, community)."""
    return f"""{LINES}, half AS MATERIALIZED ({edges}),
m AS MATERIALIZED (SELECT i, j, coalesce(w, 0.0) AS w FROM (SELECT i.range AS i, j.range AS j FROM range({n}) i, range({n}) j) g LEFT JOIN (SELECT * FROM half UNION ALL SELECT j, i, w FROM half) q USING (i, j)),
c AS (SELECT n_nationkey AS node, n_regionkey AS community FROM nation), k AS (SELECT i AS node, sum(w) AS s, sum((w > 0)::INT) AS d FROM m GROUP BY i)"""


STRONG = "SELECT a AS i, b AS j, sum(w) / 1e6 AS w FROM lines GROUP BY a, b QUALIFY sum(w) > avg(sum(w)) OVER ()"


def _samples(b: int, n: int, strong: bool = False) -> str:
    """g(r, i, j, w): the matrices of Poisson resamples, zeros included."""
    cut = " QUALIFY w > avg(w) OVER (PARTITION BY r)" if strong else ""
    return f"""{_numbered()}, {_poisson(b, 's')}, y AS MATERIALIZED (SELECT r, a AS i, b AS j, w / 1e6 AS w FROM x{cut}),
g AS MATERIALIZED (SELECT r, i, j, coalesce(w, 0.0) AS w FROM (SELECT r.range AS r, i.range AS i, j.range AS j FROM range({b}) r, range({n}) i, range({n}) j) z LEFT JOIN (SELECT * FROM y UNION ALL SELECT r, j, i, w FROM y) q USING (r, i, j)),
c AS (SELECT n_nationkey AS node, n_regionkey AS community FROM nation)"""


def _paths(source: str, keys: str = "", absent: str = "1e300", name: str = "d") -> str:
    """d5(keys, i, j, d): all-pairs path lengths of source(keys, i, j, w), by min-plus squaring."""
    on = "".join(f" AND x.{k.strip()} = y.{k.strip()}" for k in keys.split(",") if k.strip())
    own = "".join(f"x.{k.strip()}, " for k in keys.split(",") if k.strip())
    steps = [f"{name}0 AS MATERIALIZED (SELECT {keys} i, j, CASE WHEN i = j THEN 0 WHEN w > 0 THEN 1 / w ELSE {absent} END AS d FROM {source})"]
    steps += [f"{name}{k} AS MATERIALIZED (SELECT {own} x.i, y.j, min(x.d + y.d) AS d FROM {name}{k - 1} x JOIN {name}{k - 1} y ON x.j = y.i{on} GROUP BY ALL)" for k in range(1, 6)]
    return ", ".join(steps)


def _cohort(where: str = "true") -> str:
    """e(subject, grp, i, j, w) and its dense form z, zeros for a subject without the edge."""
    return f"""{LINES},
e AS MATERIALIZED (SELECT subject, 2 - (subject < 12)::INT AS grp, a AS i, b AS j, sum(w * CASE WHEN subject < 12 THEN 10 ELSE 7 END) / 1e7 AS w FROM lines WHERE {where} GROUP BY subject, a, b),
who AS (SELECT DISTINCT subject, grp FROM e),
z AS MATERIALIZED (SELECT subject, grp, i, j, coalesce(w, 0.0) AS w FROM (SELECT * FROM who, (SELECT DISTINCT i, j FROM e) q) g LEFT JOIN e USING (subject, grp, i, j))"""


def _relabelled(permutations: int) -> str:
    """who_in(perm, subject, g): 0 is the true grouping, the others take the first by hash as group 1."""
    return f"""who_in AS MATERIALIZED (SELECT perm, subject, CASE WHEN perm = 0 THEN grp WHEN row_number() OVER (PARTITION BY perm ORDER BY {_hash(42, 'perm', 'subject')}, subject) <= (SELECT count(*) FROM who WHERE grp = 1) THEN 1 ELSE 2 END AS g FROM who, range({permutations + 1}) t(perm))"""


def _welch(source: str, keys: str = "") -> str:
    return f"""SELECT {keys} i, j, avg(w) FILTER (g = 1) - avg(w) FILTER (g = 2) AS diff, coalesce(var_samp(w) FILTER (g = 1) / count(*) FILTER (g = 1) + var_samp(w) FILTER (g = 2) / count(*) FILTER (g = 2), 0) AS v FROM {source} GROUP BY {keys} i, j"""


def _corrected(kind: str, pairs: int) -> str:
    if kind == "bonferroni":
        return f"least(1.0, p * {pairs})"
    return f"least(1.0, min(p * {pairs}.0 / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


def _perm_edges(kind: str, n: int) -> str:
    return f"""WITH {_cohort()}, {_relabelled(100)},
t AS MATERIALIZED (SELECT perm, i, j, round(avg(w) FILTER (g = 1) - avg(w) FILTER (g = 2), 9) AS d FROM who_in JOIN z USING (subject) GROUP BY perm, i, j),
p AS (SELECT i, j, o.d AS diff, (SELECT count(*) FROM t q WHERE q.perm > 0 AND q.i = o.i AND q.j = o.j AND abs(q.d) >= abs(o.d)) / 100.0 AS p FROM t o WHERE perm = 0),
r AS (SELECT *, row_number() OVER (ORDER BY p, i, j) AS rk FROM p),
v AS (SELECT i, j, sqrt((sum(n1 * v) / (sum(n1) - 2))) AS sd FROM (SELECT i, j, grp, var_pop(w) AS v, count(*) AS n1 FROM z GROUP BY ALL) GROUP BY i, j)
SELECT i, j, {_rounded('diff p', 3)}, round({_corrected(kind, n * (n - 1) // 2)}, 3) AS p_corrected, round(CASE WHEN sd > 1e-9 THEN diff / sd ELSE 0 END, 3) AS d FROM r JOIN v USING (i, j)"""


def _perm_global(metric: str, tail: str) -> str:
    return f"""WITH {_cohort()}, {_relabelled(200)}, x AS (SELECT subject, {metric} FROM e GROUP BY subject),
t AS MATERIALIZED (SELECT perm, round(avg(x) FILTER (g = 1) - avg(x) FILTER (g = 2), 8) AS d FROM who_in JOIN x USING (subject) GROUP BY perm) {tail}"""


_GLOBAL = """SELECT round(d, 3) AS diff, round((SELECT count(*) FROM t WHERE perm > 0 AND abs(d) >= abs(o.d)) / 200.0, 3) AS p,
  round(d / (SELECT sqrt(sum(v * n) / (sum(n) - 2)) FROM (SELECT var_pop(x) AS v, count(*) AS n FROM x JOIN who USING (subject) GROUP BY grp)), 3) AS d FROM t o WHERE perm = 0"""


def _cpm(n_boot: int, tail: str) -> str:
    """guess(r, subject, value, y): the bagged models with DuckDB's corr and regr_ functions over rows drawn again and again."""
    cut = critical_r(24, 0.01)
    return f"""WITH {_cohort()}, bh AS (SELECT CAST(c_custkey % 24 AS INT) AS subject, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY ALL),
mem AS (SELECT subject, value, row_number() OVER (ORDER BY subject) - 1 AS k FROM bh),
bag AS MATERIALIZED (SELECT r, m.subject, m.value FROM (SELECT r, {_hash(42, 'r', 'k')} % (SELECT count(*) FROM mem) AS pick FROM mem, range({n_boot}) t(r)) d JOIN mem m ON m.k = d.pick),
cor AS MATERIALIZED (SELECT r, i, j, corr(w, value) AS c FROM bag JOIN z USING (subject) GROUP BY r, i, j HAVING stddev_pop(w) > 1e-9 AND stddev_pop(value) > 1e-9),
mark AS MATERIALIZED (SELECT r, i, j, sign(c) AS s FROM cor WHERE abs(c) > {cut!r}),
score AS MATERIALIZED (SELECT t.r, mem.subject, mem.value, coalesce((SELECT sum(s * w) FROM mark JOIN z USING (i, j) WHERE mark.r = t.r AND z.subject = mem.subject), 0.0) AS x FROM mem, range({n_boot}) t(r)),
fit AS (SELECT r, regr_slope(b.value, x) AS slope, regr_intercept(b.value, x) AS icept, stddev_pop(x) AS sd FROM bag b JOIN score USING (r, subject) GROUP BY r),
guess AS MATERIALIZED (SELECT r, subject, value, CASE WHEN sd > 1e-6 THEN icept + slope * x ELSE x END AS y FROM score JOIN fit USING (r)),
pr AS (SELECT subject, any_value(value) AS actual, avg(y) AS predicted, quantile_cont(y, 0.025) AS ci_low, quantile_cont(y, 0.975) AS ci_high FROM guess GROUP BY subject) {tail}"""


_PLS = """bh AS (SELECT CAST(c_custkey % 24 AS INT) AS subject, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY ALL),
cov AS (SELECT i, j, covar_pop(w, value) * count(*) AS c FROM z JOIN bh USING (subject) GROUP BY i, j), u AS MATERIALIZED (SELECT i, j, c / sqrt(sum(c * c) OVER ()) AS weight FROM cov),
sc AS MATERIALIZED (SELECT subject, sum(weight * w) - avg(sum(weight * w)) OVER () AS brain, any_value(value) - avg(any_value(value)) OVER () AS behaviour FROM z JOIN u USING (i, j) JOIN bh USING (subject) GROUP BY subject)"""

_PROFILES = """pf AS MATERIALIZED (SELECT vec_id AS sid, label, CAST(unnest(range(len(embedding))) AS INT) AS pt, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


def _tract(permutations: int, tail: str) -> str:
    """tt(perm, pt, diff, t, d) by var_samp over the lines of each group; the two-sided p by Simpson's rule over the t density."""
    return f"""WITH {_PROFILES}, ln AS (SELECT DISTINCT sid, (label >= 5)::INT + 1 AS grp FROM pf),
gr AS MATERIALIZED (SELECT perm, sid, CASE WHEN perm = 0 THEN grp WHEN row_number() OVER (PARTITION BY perm ORDER BY {_hash(42, 'perm', 'sid')}, sid) <= (SELECT count(*) FROM ln WHERE grp = 1) THEN 1 ELSE 2 END AS g FROM ln, range({permutations + 1}) t(perm)),
mo AS (SELECT perm, pt, g, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM gr JOIN pf USING (sid) GROUP BY perm, pt, g),
pa AS (SELECT a.perm, a.pt, a.m - b.m AS diff, a.n + b.n - 2 AS df, sqrt(((a.n - 1) * a.s + (b.n - 1) * b.s) / (a.n + b.n - 2)) AS sp, sqrt(1.0 / a.n + 1.0 / b.n) AS h FROM mo a JOIN mo b ON a.perm = b.perm AND a.pt = b.pt AND a.g = 1 AND b.g = 2),
tt AS MATERIALIZED (SELECT perm, pt, diff, df, round(diff / sp / h, 9) AS t, diff / sp AS d FROM pa),
pv AS MATERIALIZED (SELECT pt, any_value(diff) AS diff, any_value(t) AS t, any_value(d) AS d, greatest(0.0, 1 - 2 * sum(CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi() * df) * pow(1 + pow(abs(t) * k / 2000, 2) / df, -(df + 1) / 2)) * any_value(abs(t)) / 6000) AS p FROM tt, range(2001) q(k) WHERE perm = 0 GROUP BY pt),
isl AS (SELECT *, pt - row_number() OVER (PARTITION BY perm ORDER BY pt) AS island FROM tt WHERE abs(t) > 1.0),
cl AS MATERIALIZED (SELECT perm, min(pt) AS first_pt, max(pt) AS last_pt, count(*) AS extent, round(sum(abs(t)), 6) AS mass, arg_max(t, abs(t) * 1000000 - pt / 1e6) AS peak FROM isl GROUP BY perm, island),
ct AS MATERIALIZED (SELECT *, (SELECT count(*) FROM (SELECT max(mass) AS top FROM cl WHERE perm > 0 GROUP BY perm) WHERE top >= o.mass) / {max(permutations, 1)}.0 AS p FROM cl o WHERE perm = 0) {tail}"""


def _tract_corrected(expression: str) -> str:
    return _tract(0, f"SELECT pt, {_rounded('diff t d p')}, round({expression}, 6) AS p_corrected FROM (SELECT *, row_number() OVER (ORDER BY p, pt) AS rk, count(*) OVER () AS n FROM pv)")


_FDR = "least(1.0, min(p * n / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"

_BANDS = f"""ln2 AS (SELECT sid, row_number() OVER (ORDER BY sid) - 1 AS k FROM (SELECT DISTINCT sid FROM pf)),
dr AS (SELECT r, l.sid, 1.0 + l.sid % 3 AS weight FROM (SELECT r, {_hash(42, 'r', 'k')} % (SELECT count(*) FROM ln2) AS pick FROM ln2, range(20) t(r)) d JOIN ln2 l ON l.k = d.pick),
mn AS MATERIALIZED (SELECT r, pt, sum(weight * v) / sum(weight) AS v FROM dr JOIN pf USING (sid) GROUP BY r, pt),
bd AS (SELECT pt, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high, median(v) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM mn GROUP BY pt)"""


def _resampled(points: str) -> str:
    """rs(sid, k, x, y, z): the segment of each target is the last that begins at or before it."""
    return f"""pts AS MATERIALIZED ({points}),
st AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS step FROM pts WINDOW w AS (PARTITION BY sid ORDER BY pt)),
ar AS MATERIALIZED (SELECT *, round(sum(step) OVER (PARTITION BY sid ORDER BY pt), 9) AS s FROM st),
sg AS MATERIALIZED (SELECT *, lead(s) OVER w AS s2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(z) OVER w AS z2 FROM ar WINDOW w AS (PARTITION BY sid ORDER BY pt)),
tg AS (SELECT sid, k, round(total * k / 19.0, 9) AS target FROM (SELECT sid, max(s) AS total FROM ar GROUP BY sid), range(20) t(k)),
rs AS MATERIALIZED (SELECT sid, CAST(k AS INT) AS k, x + f * (x2 - x) AS x, y + f * (y2 - y) AS y, z + f * (z2 - z) AS z FROM (
  SELECT t.sid, t.k, g.*, least(1.0, (target - s) / greatest(s2 - s, 1e-10)) AS f FROM tg t ASOF JOIN (SELECT * EXCLUDE (sid), sid AS gs FROM sg WHERE s2 IS NOT NULL) g ON t.sid = g.gs AND t.target >= g.s))"""


#: Cells of the volume at whole places, as the view makes them.
_CELL = "((({i}) * 7 + ({j}) * 3 + ({k}) * 5) % 11) / 10.0"


def _sampled() -> str:
    """vp(sid, pt, v): interpolation along one axis after the other."""
    spot = "least(greatest(round(({c} + 4) / 2, 9), 0), 19)"
    cell = lambda a, b, c: _CELL.format(i=f"least(fi + {a}, 19)", j=f"least(fj + {b}, 19)", k=f"least(fk + {c}, 19)")
    along_k = lambda a, b: f"({cell(a, b, 0)}) * (1 - gk) + ({cell(a, b, 1)}) * gk"
    along_j = lambda a: f"({along_k(a, 0)}) * (1 - gj) + ({along_k(a, 1)}) * gj"
    triples = "SELECT vec_id AS sid, CAST(p AS INT) AS pt, 20 + 12 * embedding[3 * p + 1]::DOUBLE AS x, 20 + 12 * embedding[3 * p + 2]::DOUBLE AS y, 20 + 12 * embedding[3 * p + 3]::DOUBLE AS z FROM embeddings, range(21) t(p)"
    return f"""{_resampled(triples)}, spot AS (SELECT sid, k AS pt, {spot.format(c='x')} AS vi, {spot.format(c='y')} AS vj, {spot.format(c='z')} AS vk FROM rs),
fl AS (SELECT sid, pt, CAST(floor(vi) AS INT) AS fi, CAST(floor(vj) AS INT) AS fj, CAST(floor(vk) AS INT) AS fk, vi - floor(vi) AS gi, vj - floor(vj) AS gj, vk - floor(vk) AS gk FROM spot),
vp AS MATERIALIZED (SELECT sid, pt, ({along_j(0)}) * (1 - gi) + ({along_j(1)}) * gi AS v FROM fl)"""


def _table(matrix: np.ndarray, name: str) -> str:
    """name(g, row): the rows of a matrix as lists."""
    return f"{name} AS (SELECT * FROM (VALUES " + ", ".join(f"({g}, [{', '.join(map(repr, map(float, row)))}])" for g, row in enumerate(matrix)) + ") t(g, row))"


def _dti(digits: int = 7) -> str:
    """The fit and refit by the normal equations' inverse, instead of the pseudo-inverse, as list products."""
    bvals, bvecs = voxel.gradients()
    x = voxel.tensor_design(bvals, bvecs)
    solve = np.linalg.inv(x.T @ x) @ x.T
    hat = x @ solve
    scale = 1 / (1 - np.diag(hat))
    return f"""WITH {_PROFILES}, {_table(hat, 'hat')}, {_table(solve, 'sol')}, {_table(scale[:, None], 'sca')},
y AS MATERIALIZED (SELECT sid AS voxel, list(ln(greatest(100 * exp(v), 1e-6)) ORDER BY pt) AS y FROM pf GROUP BY sid),
fi AS (SELECT voxel, g, list_dot_product(y, row) AS yhat, y[g + 1] AS y0 FROM y, hat),
fl AS (SELECT r, voxel, list(yhat + (y0 - yhat) * row[1] * (2 * ({_hash(42, 'r', 'voxel', 'g')} % 2) - 1) ORDER BY g) AS y FROM fi JOIN sca USING (g), range(3) t(r) GROUP BY r, voxel)
SELECT r, voxel, g AS c, round(list_dot_product(y, row), {digits}) AS value FROM fl, sol WHERE g > 0"""


def _csd() -> str:
    m = voxel.harmonics(voxel.directions(64), 8) * voxel.response_diagonal([1.0, 0.5, 0.1], 8)[None, :]
    solve = np.linalg.inv(m.T @ m) @ m.T
    return f"""WITH {_PROFILES}, {_table(m @ solve, 'hat')}, {_table(solve, 'sol')},
y AS MATERIALIZED (SELECT sid AS voxel, list(100 * exp(v) ORDER BY pt) AS y FROM pf GROUP BY sid),
fi AS (SELECT voxel, list(list_dot_product(y, row) ORDER BY g) AS yhat, any_value(y) AS y FROM y, hat GROUP BY voxel),
dr AS (SELECT r, voxel, list(yhat[g + 1] + y[h + 1] - yhat[h + 1] ORDER BY g) AS y FROM (SELECT *, {_hash(42, 'r', 'voxel', 'g')} % 64 AS h FROM fi, range(2) t(r), range(64) q(g)) GROUP BY r, voxel)
SELECT r, voxel, g AS c, round(greatest(list_dot_product(y, row), 0.0), 4) AS value FROM dr, sol"""


def _supra(permutations: int, threshold: float) -> str:
    """up(perm, i, j, t, label): supra-threshold edges with the smallest node that theirs reach, by squaring the reach."""
    reach = ["re0 AS MATERIALIZED (SELECT DISTINCT perm, i AS p, j AS q FROM (SELECT perm, i, j FROM su UNION ALL SELECT perm, j, i FROM su UNION ALL SELECT perm, i, i FROM su UNION ALL SELECT perm, j, j FROM su))"]
    reach += [f"re{k} AS MATERIALIZED (SELECT DISTINCT x.perm, x.p, y.q FROM re{k - 1} x JOIN re{k - 1} y ON x.perm = y.perm AND x.q = y.p)" for k in range(1, 6)]
    return f"""{_cohort()}, {_relabelled(permutations)}, wt AS MATERIALIZED ({_welch('(SELECT perm, g, i, j, w FROM who_in JOIN z USING (subject))', 'perm,')}),
tv AS MATERIALIZED (SELECT perm, i, j, round(CASE WHEN v > 1e-18 THEN diff / sqrt(v) ELSE 0 END, 9) AS t FROM wt),
su AS MATERIALIZED (SELECT * FROM tv WHERE abs(t) > {threshold}), {', '.join(reach)},
up AS MATERIALIZED (SELECT su.perm, i, j, t, CAST(label AS INT) AS component FROM su JOIN (SELECT perm, p, min(q) AS label FROM re5 GROUP BY ALL) l ON l.perm = su.perm AND l.p = su.i),
sz AS MATERIALIZED (SELECT perm, component, count(*) AS size FROM up GROUP BY ALL),
pv AS MATERIALIZED (SELECT component, size, (SELECT count(*) FROM (SELECT max(size) AS top FROM sz WHERE perm > 0 GROUP BY perm) WHERE top >= o.size) / {permutations}.0 AS p FROM sz o WHERE perm = 0)"""


def _tfnbs(permutations: int) -> str:
    reach = ["re0 AS MATERIALIZED (SELECT DISTINCT perm, h, i AS p, j AS q FROM (SELECT perm, h, i, j FROM su UNION ALL SELECT perm, h, j, i FROM su UNION ALL SELECT perm, h, i, i FROM su UNION ALL SELECT perm, h, j, j FROM su))"]
    reach += [f"re{k} AS MATERIALIZED (SELECT DISTINCT x.perm, x.h, x.p, y.q FROM re{k - 1} x JOIN re{k - 1} y ON x.perm = y.perm AND x.h = y.h AND x.q = y.p)" for k in range(1, 6)]
    return f"""WITH {_cohort()}, {_relabelled(permutations)}, wt AS MATERIALIZED ({_welch('(SELECT perm, g, i, j, w FROM who_in JOIN z USING (subject))', 'perm,')}),
tv AS MATERIALIZED (SELECT perm, i, j, round(CASE WHEN v > 1e-18 THEN diff / sqrt(v) ELSE 0 END, 9) AS t FROM wt),
su AS MATERIALIZED (SELECT perm, h, i, j, t FROM tv, range(1, 400) q(h) WHERE abs(t) > h * 0.1), {', '.join(reach)},
lb AS MATERIALIZED (SELECT su.*, count(*) OVER (PARTITION BY su.perm, su.h, label) AS size FROM su JOIN (SELECT perm, h, p, min(q) AS label FROM re5 GROUP BY ALL) l ON l.perm = su.perm AND l.h = su.h AND l.p = su.i),
so AS MATERIALIZED (SELECT perm, i, j, sum(sign(t) * sqrt(size) * pow(h * 0.1, 2) * 0.1) AS score FROM lb GROUP BY perm, i, j),
pv AS (SELECT i, j, score, (SELECT count(*) FROM (SELECT max(round(abs(score), 9)) AS top FROM so WHERE perm > 0 GROUP BY perm) WHERE top >= round(abs(o.score), 9)) / {permutations}.0 AS p FROM so o WHERE perm = 0)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(score, 4) AS score, round(p, 6) AS p, p < 0.05 AS significant FROM pv"""


def _ways(source: str, keys: str = "") -> str:
    """sh(keys, node, share): every shortest path written out; each inner node takes its share of the pair's paths."""
    each = [k.strip() for k in keys.split(",") if k.strip()]
    own = "".join(f"p.{k}, " for k in each)
    on = lambda a: "".join(f" AND {a}.{k} = p.{k}" for k in each)
    return f"""wa({keys} s, t, way) AS (SELECT DISTINCT {keys} i, i, [i] FROM {source} UNION ALL SELECT {own} p.s, e.j, list_append(p.way, e.j) FROM wa p JOIN {source} e ON e.i = p.t AND e.w > 0{on('e')}
  JOIN d5 x ON x.i = p.s AND x.j = p.t{on('x')} JOIN d5 y ON y.i = p.s AND y.j = e.j{on('y')} WHERE abs(x.d + 1 / e.w - y.d) < 1e-10 AND NOT list_contains(p.way, e.j)),
sh AS MATERIALIZED (SELECT {keys} unnest(way[2:-2]) AS node, 1.0 / count(*) OVER (PARTITION BY {keys} s, t) AS share FROM wa WHERE s <> t)"""


def _exponential(n: int) -> str:
    """ex(r, i, j, value): the exponential of each matrix over its largest eigenvalue, by power iteration and Taylor's series."""
    steps = ["v0 AS (SELECT r, i, 1.0::DOUBLE AS x FROM g WHERE j = 0)"]
    for k in range(1, 31):
        steps.append(f"v{k} AS MATERIALIZED (SELECT r, i, x / max(x) OVER (PARTITION BY r) AS x, max(x) OVER (PARTITION BY r) AS top FROM (SELECT g.r, g.i, sum(w * x) AS x FROM g JOIN v{k - 1} v ON v.r = g.r AND v.i = g.j GROUP BY ALL))")
    steps.append("a AS MATERIALIZED (SELECT g.r, g.i, g.j, w / top AS w FROM g JOIN (SELECT DISTINCT r, top FROM v30) t ON t.r = g.r)")
    steps.append("t0 AS MATERIALIZED (SELECT r, i, j, (i = j)::INT::DOUBLE AS w FROM a)")
    steps += [f"t{k} AS MATERIALIZED (SELECT x.r, x.i, y.j, sum(x.w * y.w) / {k} AS w FROM t{k - 1} x JOIN a y ON y.r = x.r AND y.i = x.j GROUP BY ALL)" for k in range(1, 19)]
    every = " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(19))
    return f"{_samples(20, n)}, {', '.join(steps)}, ex AS MATERIALIZED (SELECT r, i, j, sum(w) AS value FROM ({every}) GROUP BY r, i, j)"


def _interval(value: str, digits: int = 5) -> str:
    return f"round(avg({value}), {digits}) AS mean, round(stddev_pop({value}), {digits}) AS std, round(quantile_cont({value}, 0.025), {digits}) AS ci_low, round(quantile_cont({value}, 0.975), {digits}) AS ci_high"


def _pls(permutations: int) -> str:
    """Two behaviours: the squared singular values are the eigenvalues of a 2 x 2 matrix, in closed form."""
    return f"""WITH {_cohort()}, bh AS (SELECT CAST(c_custkey % 24 AS INT) AS subject, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY ALL),
nu AS MATERIALIZED (SELECT subject, value AS y0, sqrt(abs(value)) AS y1, row_number() OVER (ORDER BY subject) - 1 AS k FROM bh),
pm AS (SELECT n, subject, CASE WHEN n = 0 THEN k ELSE row_number() OVER (PARTITION BY n ORDER BY {_hash(42, 'n', 'k')}, k) - 1 END AS pick FROM nu, range({permutations + 1}) t(n)),
yy AS MATERIALIZED (SELECT pm.n, pm.subject, o.y0, o.y1 FROM pm JOIN nu o ON o.k = pm.pick),
co AS (SELECT n, i, j, covar_pop(w, y0) * count(*) AS a, covar_pop(w, y1) * count(*) AS c FROM yy JOIN z USING (subject) GROUP BY n, i, j),
ga AS (SELECT n, sum(a * a) AS p, sum(a * c) AS q, sum(c * c) AS s FROM co GROUP BY n),
sv AS MATERIALIZED (SELECT n, component, sqrt(greatest(0, (p + s) / 2 + (1 - 2 * component) * sqrt(pow((p - s) / 2, 2) + q * q))) AS v FROM ga, range(2) t(component))
SELECT CAST(component AS INT) AS component, round(v, 4) AS singular_value, round(v * v / sum(v * v) OVER (), 4) AS explained, round((SELECT count(*) FROM sv x WHERE x.n > 0 AND x.component = o.component AND x.v >= o.v) / {permutations}.0, 4) AS p FROM sv o WHERE n = 0"""


def sql(n: int, b: int) -> dict[str, str]:
    """Query -> SQL, for n parcels and b replicates."""
    stats_cols = "observed mean std cv ci_low ci_high median iqr p_nonzero"
    label = "CASE WHEN p_nonzero < 0.05 THEN (p_nonzero > 0)::INT WHEN p_nonzero < 0.5 THEN 2 WHEN p_nonzero >= 0.95 AND cv < 0.5 THEN 4 ELSE 3 END"
    prevalence = f"""{_cohort(TIERED)}, pre AS (SELECT i, j, sum((w > 0)::INT) / count(*) AS p_nonzero, round(stddev_pop(w) / avg(w), 6) AS cv FROM z GROUP BY i, j), cls AS (SELECT *, {label} AS label FROM pre)"""
    cube = "SELECT {key} x.i AS node, sum(cbrt(x.w) * cbrt(y.w) * cbrt(z.w)) AS t FROM {m} x JOIN {m} y ON y.i = x.j {a} JOIN {m} z ON z.i = y.j AND z.j = x.i {b} GROUP BY ALL"
    tri = cube.format(key="", m="m", a="", b="")
    part = "SELECT i AS node, 1 - sum(pow(CASE WHEN s > 0 THEN t / s ELSE 0 END, 2)) AS participation FROM (SELECT i, community, sum(w) AS t, sum(sum(w)) OVER (PARTITION BY i) AS s FROM m JOIN c ON c.node = j GROUP BY i, community) GROUP BY i"
    zed = "SELECT node, coalesce(CASE WHEN stddev_pop(own) OVER p > 1e-12 THEN (own - avg(own) OVER p) / stddev_pop(own) OVER p END, 0.0) AS z FROM (SELECT a.node, a.community, sum(CASE WHEN a.community = d.community THEN w ELSE 0 END) AS own FROM c a JOIN m ON i = a.node JOIN c d ON d.node = j GROUP BY ALL) WINDOW p AS (PARTITION BY community)"
    hubs = f"{_matrix(n)}, pa AS ({part}), ze AS ({zed}), hub AS (SELECT node, s AS strength, participation, z, CASE WHEN s <= (SELECT quantile_cont(s, 0.8) FROM k) THEN 0 ELSE 1 + (participation >= 0.3)::INT + (participation >= 0.75)::INT END AS hub_class FROM k JOIN pa USING (node) JOIN ze USING (node))"
    parts = "pt AS MATERIALIZED (SELECT r, n_nationkey AS node, (n_nationkey * (r + 3) + r) % 5 AS community FROM nation, range(8) t(r))"
    far = f"{_matrix(n)}, {_paths('m')}"
    nn = n * (n - 1)
    hub_runs = f"""{_samples(20, n)}, st AS MATERIALIZED (SELECT r, i AS node, sum(w) AS s FROM g GROUP BY ALL), top AS (SELECT r, quantile_cont(s, 0.8) AS cut FROM st GROUP BY r),
tw AS MATERIALIZED (SELECT g.r, g.i AS node, d.community AS toward, o.community AS own, sum(w) AS t FROM g JOIN c d ON d.node = g.j JOIN c o ON o.node = g.i GROUP BY ALL),
pa AS (SELECT r, node, 1 - sum(t * t) / pow(sum(t), 2) AS participation FROM tw GROUP BY r, node),
ze AS (SELECT r, node, CASE WHEN stddev_pop(t) OVER q > 1e-12 THEN (t - avg(t) OVER q) / stddev_pop(t) OVER q ELSE 0 END AS z FROM tw WHERE toward = own WINDOW q AS (PARTITION BY r, own)),
al AS MATERIALIZED (SELECT r, node, participation, z, CASE WHEN s <= cut THEN 0 WHEN participation < 0.3 THEN 1 WHEN participation < 0.75 THEN 2 ELSE 3 END AS hub_class FROM st JOIN top USING (r) JOIN pa USING (r, node) JOIN ze USING (r, node)),
mo AS (SELECT node, hub_class, count(*) / 20.0 AS stability FROM al GROUP BY node, hub_class QUALIFY row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, hub_class) = 1)"""
    cells = f"""{_samples(20, n)}, {_paths('g', 'r,')}, kk AS MATERIALIZED (SELECT r, i AS node, sum(w) AS s, sum((w > 0)::INT) AS d FROM g GROUP BY ALL),
nb AS (SELECT o.r, o.i AS node, a.i AS i, a.j AS j, a.w AS w FROM g o JOIN g p ON p.r = o.r AND p.i = o.i AND p.w > 0 JOIN g a ON a.r = o.r AND a.i = o.j AND a.j = p.j WHERE o.w > 0),
{_paths('nb', 'r, node,', name='e')},
le AS (SELECT r, avg(v) AS v FROM (SELECT kk.r, kk.node, coalesce(any_value(q.v), 0.0) AS v FROM kk LEFT JOIN (SELECT r, node, sum(CASE WHEN i <> j AND d < 1e299 THEN 1 / d ELSE 0 END) / (count(*) - sqrt(count(*))) AS v FROM e5 GROUP BY r, node HAVING count(*) > 1) q USING (r, node) GROUP BY kk.r, kk.node) GROUP BY r),
tr AS MATERIALIZED ({cube.format(key='x.r,', m='g', a='AND y.r = x.r', b='AND z.r = x.r')}),
va AS (SELECT r, 'density' AS metric, sum(d) / {nn} AS value FROM kk GROUP BY r UNION ALL SELECT r, 'mean_strength', avg(s) FROM kk GROUP BY r UNION ALL SELECT r, 'strength_std', stddev_pop(s) FROM kk GROUP BY r
  UNION ALL SELECT r, 'global_efficiency', sum(CASE WHEN i <> j AND d < 1e299 THEN 1 / d ELSE 0 END) / {nn} FROM d5 GROUP BY r UNION ALL SELECT r, 'path_length', avg(d) FROM d5 WHERE i <> j AND d < 1e299 GROUP BY r
  UNION ALL SELECT r, 'clustering', avg(t / (d * (d - 1))) FROM tr JOIN kk USING (r, node) WHERE d >= 2 GROUP BY r UNION ALL SELECT r, 'transitivity', sum(t) / sum(d * (d - 1)) FROM tr JOIN kk USING (r, node) GROUP BY r
  UNION ALL SELECT r, 'local_efficiency', v FROM le)"""
    return {
        "build_sc": f"WITH {LINES} SELECT a AS i, b AS j, CAST(sum(w) AS BIGINT) AS w FROM lines GROUP BY a, b",
        "bootstrap_edge_stats": f"WITH {_multinomial(b)}, {_stats(b)} SELECT i, j, {_rounded(stats_cols)} FROM stats",
        "bootstrap_poisson": f"WITH {_numbered()}, {_poisson(b, 's')}, {_stats(b)} SELECT i, j, {_rounded(stats_cols)} FROM stats",
        "bootstrap_normal_ci": f"WITH {_multinomial(b)}, {_stats(b, True)} SELECT i, j, {_rounded('mean ci_low ci_high', 5)} FROM stats",
        "classify_edges": f"WITH {_multinomial(b, SPARSE)}, {_stats(b)} SELECT i, j, {label} AS label, {_rounded('p_nonzero cv')} FROM stats",
        "classify_prevalence": f"WITH {prevalence} SELECT i, j, label, {_rounded('p_nonzero cv')} FROM cls",
        "edge_class_counts": f"WITH {prevalence} SELECT l.range::INT AS label, CAST(CASE WHEN l.range = 0 THEN {nn // 2} - (SELECT count(*) FROM cls WHERE label > 0) ELSE (SELECT count(*) FROM cls WHERE label = l.range) END AS DOUBLE) AS n FROM range(5) l",
        "parametric_samples": f"WITH {_multinomial(b)}, {_stats(b)} SELECT r, i, j, round(greatest(0.0, mean + std * (sqrt(-2 * ln(u)) * cos(2 * pi() * v) + sqrt(-2 * ln(u)) * sin(2 * pi() * v)) / 2), 3) AS w FROM (SELECT r, i, j, mean, std, ({_hash(42, 'r', 'i', 'j')} + 0.5) / 4294967296 AS u, ({_hash(43, 'r', 'i', 'j')} + 0.5) / 4294967296 AS v FROM stats, range(5) t(r))",
        "disparity_backbone": f"WITH {_matrix(n)}, al AS (SELECT i, j, w, CASE WHEN d >= 2 THEN pow(1 - w / s, d - 1) ELSE 1 END AS alpha FROM m JOIN k ON node = i WHERE w > 0) SELECT i, j, (least(x.alpha, y.alpha) < 0.1)::INT AS kept, round(x.w, 6) AS w FROM al x JOIN (SELECT i AS yj, j AS yi, alpha FROM al) y ON yi = x.i AND yj = x.j WHERE i < j",
        "disparity_summary": f"WITH {_matrix(n)}, al AS (SELECT i, j, w, CASE WHEN d >= 2 THEN pow(1 - w / s, d - 1) ELSE 1 END AS alpha FROM m JOIN k ON node = i WHERE w > 0), ke AS (SELECT any_value(w) AS w, min(alpha) < 0.1 AS kept FROM al GROUP BY least(i, j), greatest(i, j)) SELECT CAST(sum(kept::INT) AS BIGINT) AS n_retained, count(*) AS n_total, round(coalesce(sum(w) FILTER (kept), 0) / sum(w), 6) AS weight_retained FROM ke",
        "assignments_from_sc": f"WITH {_matrix(n)}, ex AS (SELECT i, j, w, t.k, -ln(({_hash(42, 'i', 'j', 't.k')} + 0.5) / 4294967296) AS x FROM half, range(30) t(k) WHERE t.k < greatest(1, floor(30 * w / (SELECT max(w) FROM half)))) SELECT i AS a, j AS b, k, round(w * x / sum(x) OVER (PARTITION BY i, j), 5) AS weight FROM ex",
        "node_strength": f"WITH {_matrix(n)} SELECT CAST(node AS INT) AS node, CAST(d AS BIGINT) AS degree, round(s, 6) AS strength FROM k",
        "strength_summary": f"WITH {_matrix(n)} SELECT round(avg(d) / ({n} - 1), 6) AS density, round(avg(s), 6) AS mean_strength, round(stddev_pop(s), 6) AS strength_std FROM k",
        "modularity_fixed": f"WITH {_matrix(n)}, t AS (SELECT sum(s) AS t FROM k) SELECT round(sum(CASE WHEN a.community = d.community THEN w - p.s * q.s / t ELSE 0 END) / any_value(t), 6) AS modularity FROM m JOIN c a ON a.node = i JOIN c d ON d.node = j JOIN k p ON p.node = i JOIN k q ON q.node = j, t",
        "transitivity": f"WITH {_matrix(n)}, t AS ({tri}) SELECT round((SELECT sum(t) FROM t) / (SELECT sum(d * (d - 1)) FROM k), 6) AS transitivity",
        "clustering": f"WITH {_matrix(n)}, t AS ({tri}) SELECT round(avg(t / (d * (d - 1))), 6) AS clustering FROM t JOIN k USING (node) WHERE d >= 2",
        "participation": f"WITH {_matrix(n)} SELECT CAST(node AS INT) AS node, round(participation, 6) AS participation FROM ({part})",
        "within_module_z": f"WITH {_matrix(n)} SELECT node, round(z, 6) AS z FROM ({zed})",
        "hub_class": f"WITH {hubs} SELECT CAST(node AS INT) AS node, hub_class, {_rounded('strength participation z')} FROM hub",
        "rich_club_phi": f"WITH {_matrix(n, STRONG)}, ri AS (SELECT t.k, x.node FROM range(24) t(k), k x WHERE x.d > t.k), pr AS (SELECT a.k, sum(w) AS w, count(*) AS cells FROM ri a JOIN ri b ON a.k = b.k AND a.node < b.node JOIN m ON i = a.node AND j = b.node GROUP BY a.k) SELECT CAST(t.k AS INT) AS k, (SELECT count(*) FROM ri WHERE ri.k = t.k) AS n_rich, round(coalesce(w / cells, 0.0), 6) AS phi FROM range(24) t(k) LEFT JOIN pr ON pr.k = t.k",
        "coassignment_fixed": f"WITH {parts} SELECT a.node AS i, z.node AS j, round(avg((a.community = z.community)::INT), 6) AS p FROM pt a JOIN pt z ON a.r = z.r AND a.node < z.node GROUP BY ALL HAVING sum((a.community = z.community)::INT) > 0",
        "edge_ttest": f"WITH {_cohort()}, t AS ({_welch('(SELECT grp AS g, * FROM z)')}) SELECT i, j, round(diff, 3) AS diff, round(CASE WHEN v > 1e-18 THEN diff / sqrt(v) ELSE 0 END, 3) AS t FROM t",
        "perm_edges_fdr": _perm_edges("fdr", n),
        "perm_edges_bonferroni": _perm_edges("bonferroni", n),
        "perm_global_weight": _perm_global("round(sum(w), 6) AS x", _GLOBAL),
        "perm_global_edges": _perm_global("sum((w > 0.3)::INT) AS x", _GLOBAL),
        "perm_global_null": _perm_global("round(sum(w), 6) AS x", "SELECT perm, round(d, 2) AS delta FROM t WHERE perm > 0"),
        "nbs_stability": f"""WITH {LINES}, sl AS (SELECT subject, a, b, CASE WHEN subject < 12 THEN w ELSE w * 0.7::DOUBLE END AS w, concat(subject, '-', a, '-', b, '-', row_number() OVER (PARTITION BY subject, a, b ORDER BY w)) AS sid FROM lines), {_poisson(5, 'sl', 'subject,')},
kd AS (SELECT subject, r, count(*) AS n FROM x GROUP BY ALL), ro AS (SELECT round, subject, {_hash(42, 'round', 'subject')} % 5 AS r FROM (SELECT DISTINCT subject FROM kd), range(12) t(round)),
dn AS (SELECT round, g.subject, 2 - (g.subject < 12)::INT AS g, g.a AS i, g.b AS j, coalesce(x.w, 0) / 1e6 AS w FROM (SELECT * FROM ro, (SELECT DISTINCT a, b FROM x) q) g LEFT JOIN x ON x.subject = g.subject AND x.r = g.r AND x.a = g.a AND x.b = g.b),
tv AS ({_welch('dn', 'round,')}) SELECT i, j, round(sum((CASE WHEN v > 1e-18 THEN abs(round(diff / sqrt(v), 9)) ELSE 0 END > 1.0)::INT) / 12.0, 6) AS freq FROM tv GROUP BY i, j""",
        "cpm_bagged": _cpm(20, f"SELECT subject, {_rounded('actual predicted ci_low ci_high', 3)} FROM pr"),
        "cpm_summary": _cpm(20, "SELECT (SELECT count(*) FROM pr) AS n, CAST(floor(sum((s > 0)::INT) / 20.0) AS BIGINT) AS edges_positive, CAST(floor(sum((s < 0)::INT) / 20.0) AS BIGINT) AS edges_negative, (SELECT round(corr(predicted, actual), 4) FROM pr) AS r FROM mark"),
        "plot_cpm": _cpm(20, "SELECT round(corr(predicted, actual), 2) AS r, round(covar_pop(predicted, actual) / var_pop(actual), 2) AS slope, round(avg(predicted) - covar_pop(predicted, actual) / var_pop(actual) * avg(actual), 2) AS intercept, round(avg(ci_high) - avg(ci_low), 2) AS width FROM pr"),
        "pls_single": f"WITH {_cohort()}, {_PLS} SELECT i, j, round(weight, 6) AS weight FROM u",
        "pls_scores": f"WITH {_cohort()}, {_PLS} SELECT subject, {_rounded('brain behaviour', 5)} FROM sc",
        "plot_pls": f"WITH {_cohort()}, {_PLS} SELECT count(*) AS n, round(covar_pop(brain, behaviour) / stddev_pop(brain) / stddev_pop(behaviour), 6) AS r FROM sc",
        "tract_bootstrap": f"WITH {_PROFILES}, {_BANDS}, ob AS (SELECT pt, sum(v * (1 + sid % 3)) / sum(1 + sid % 3) AS observed FROM pf GROUP BY pt) SELECT pt, {_rounded('mean std ci_low ci_high median q25 q75 observed')} FROM bd JOIN ob USING (pt)",
        "tract_compare": _tract(100, f"SELECT pt, {_rounded('diff t d p')}, round(coalesce((SELECT min(ct.p) FROM ct WHERE ct.p < 0.05 AND pv.pt >= first_pt AND pv.pt <= last_pt), 1.0), 6) AS p_corrected FROM pv"),
        "tract_compare_fdr": _tract_corrected(_FDR),
        "tract_compare_bonferroni": _tract_corrected("least(1.0, p * n)"),
        "tract_clusters": _tract(100, f"SELECT first_pt, last_pt, extent, {_rounded('mass peak p', 5)} FROM ct"),
        "plot_tract": _tract(0, f", {_BANDS}, co AS (SELECT pt, t, {_FDR} AS pc FROM (SELECT *, row_number() OVER (ORDER BY p, pt) AS rk, count(*) OVER () AS n FROM pv)) SELECT pt, (pc < 0.05)::INT AS significant, {_rounded('mean ci_low ci_high t', 5)} FROM bd JOIN co USING (pt)"),
        "bundle_stability": f"WITH ln AS (SELECT vec_id AS sid, label, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings), pk AS (SELECT {_hash(42, 'r', 'k')} % (SELECT count(*) FROM ln) AS pick FROM ln, range(50) t(r)) SELECT label, count(DISTINCT sid) AS n_lines, round(count(pick) / 50.0 / count(DISTINCT sid), 6) AS stability FROM ln LEFT JOIN pk ON pick = k GROUP BY label",
        "resample_streamline": f"WITH {_PROFILES}, {_resampled('SELECT sid, pt, pt::DOUBLE AS x, v AS y, 0.0::DOUBLE AS z FROM pf')} SELECT sid, k, {_rounded('x y', 4)} FROM rs",
        "tract_profile_volume": f"WITH {_sampled()} SELECT sid, pt, round(v, 4) AS v FROM vp",
        "tract_profile_summary": f"WITH {_sampled()} SELECT pt, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(sum(v * (1 + sid % 3)) / sum(1 + sid % 3), 4) AS weighted_mean FROM vp GROUP BY pt",
        "dti_wild_bootstrap": _dti(),
        "csd_residual_bootstrap": _csd(),
        "plot_uncertainty": f"WITH {_multinomial(b)}, {_stats(b)}, lg AS (SELECT list(log10(mean + 1e-10)) FILTER (log10(mean + 1e-10) > -9) AS m, list(log10(std + 1e-10)) FILTER (log10(std + 1e-10) > -9) AS s, list(cv) FILTER (cv > 0) AS c, avg(cv) FILTER (mean > 0) AS mean_cv FROM stats) SELECT round(list_aggregate(m, 'quantile_cont', 0.05), 6) AS mean_low, round(list_aggregate(m, 'quantile_cont', 0.95), 6) AS mean_high, round(list_aggregate(s, 'quantile_cont', 0.05), 6) AS std_low, round(list_aggregate(s, 'quantile_cont', 0.95), 6) AS std_high, round(list_aggregate(c, 'quantile_cont', 0.95), 6) AS cv_high, round(mean_cv, 6) AS mean_cv FROM lg",
        "plot_communities": "SELECT n_nationkey AS node, n_regionkey AS community, (SELECT count(*) FROM nation y WHERE (y.n_regionkey, y.n_nationkey) < (x.n_regionkey, x.n_nationkey)) AS place, (x.n_nationkey = (SELECT min(n_nationkey) FROM nation y WHERE y.n_regionkey = x.n_regionkey) AND n_regionkey > (SELECT min(n_regionkey) FROM nation))::INT AS boundary FROM nation x",
        "plot_clinical": f"WITH {_matrix(n)}, sc AS MATERIALIZED (SELECT node, s, score FROM k JOIN (SELECT c_nationkey AS node, avg(c_acctbal) AS score FROM customer GROUP BY ALL) USING (node)), li AS (SELECT corr(s, score) AS r, regr_slope(score, s) AS slope, regr_intercept(score, s) AS intercept FROM sc), ra AS (SELECT *, (SELECT count(*) FROM sc y WHERE y.s > sc.s OR (y.s = sc.s AND y.node < sc.node)) AS above, (SELECT count(*) FROM sc y WHERE y.s < sc.s OR (y.s = sc.s AND y.node < sc.node)) AS below FROM sc) SELECT CAST(node AS INT) AS node, CASE WHEN above < 5 THEN 'top' ELSE 'bottom' END AS side, round(s, 4) AS stability, {_rounded('score r slope intercept', 4)} FROM ra, li WHERE above < 5 OR below < 5",
        "plot_nbs": f"WITH {_cohort()}, t AS (SELECT abs(CASE WHEN v > 1e-18 THEN diff / sqrt(v) ELSE 0 END) AS t FROM ({_welch('(SELECT grp AS g, * FROM z)')})) SELECT round(quantile_cont(t, 0.95) FILTER (t <> 0), 5) AS t_high, count(*) FILTER (t > 2) AS n_beyond FROM t",
        "plot_hubs": f"WITH {hubs} SELECT CAST(node AS INT) AS node, hub_class, (SELECT count(*) FROM hub y WHERE (-y.strength, y.node) <= (-x.strength, x.node)) AS by_strength, (SELECT count(*) FROM hub y WHERE (-round(y.participation, 9), y.node) <= (-round(x.participation, 9), x.node)) AS by_participation, (SELECT count(*) FROM hub y WHERE (-y.hub_class, -y.strength, y.node) <= (-x.hub_class, -x.strength, x.node)) AS by_class, {_rounded('strength participation z')} FROM hub x",
        "shortest_paths": f"WITH {far} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(d, 6) AS d FROM d5 WHERE i < j AND d < 1e299",
        "global_efficiency": f"WITH {far} SELECT round(sum(CASE WHEN i <> j AND d < 1e299 THEN 1 / d ELSE 0 END) / {nn}, 6) AS global_efficiency FROM d5",
        "global_efficiency_compat": f"WITH {_matrix(n)}, {_paths('m', absent='0')} SELECT round(sum(CASE WHEN d > 0 THEN 1 / d ELSE 0 END) / {nn}, 6) AS global_efficiency FROM d5",
        "char_path_length": f"WITH {far} SELECT round(avg(d), 6) AS path_length FROM d5 WHERE i <> j AND d < 1e299",
        "local_efficiency": f"""WITH {_matrix(n)}, nb AS (SELECT o.i AS node, a.i AS i, a.j AS j, a.w AS w FROM m o JOIN m p ON p.i = o.i AND p.w > 0 JOIN m a ON a.i = o.j AND a.j = p.j WHERE o.w > 0), {_paths('nb', 'node,')}
SELECT CAST(k.node AS INT) AS node, round(coalesce(v, 0.0), 6) AS local_efficiency FROM k LEFT JOIN (SELECT node, sum(CASE WHEN i <> j AND d < 1e299 THEN 1 / d ELSE 0 END) / (count(*) - sqrt(count(*))) AS v FROM d5 GROUP BY node HAVING count(*) > 1) q USING (node)""",
        "betweenness": f"WITH RECURSIVE {far}, {_ways('m')} SELECT CAST(k.node AS INT) AS node, round(coalesce(sum(share), 0) / {(n - 1) * (n - 2)}, 6) AS betweenness FROM k LEFT JOIN sh USING (node) GROUP BY k.node",
        "nodal_metrics_ci": f"""WITH RECURSIVE {cells.replace("range(20)", "range(10)")}, {_ways('g', 'r,')}, loc AS (SELECT kk.r, kk.node, coalesce(q.v, 0.0) AS v FROM kk LEFT JOIN (SELECT r, node, sum(CASE WHEN i <> j AND d < 1e299 THEN 1 / d ELSE 0 END) / (count(*) - sqrt(count(*))) AS v FROM e5 GROUP BY r, node HAVING count(*) > 1) q USING (r, node)),
al AS (SELECT 'strength' AS metric, node, s AS v FROM kk UNION ALL SELECT 'local_efficiency', node, v FROM loc UNION ALL SELECT 'betweenness', kk.node, coalesce(sum(share), 0) / {(n - 1) * (n - 2)} FROM kk LEFT JOIN sh USING (r, node) GROUP BY kk.r, kk.node)
SELECT metric, CAST(node AS INT) AS node, {_interval('v')} FROM al GROUP BY metric, node""",
        "hub_betweenness": f"""WITH RECURSIVE {_samples(10, n)}, {_paths('g', 'r,')}, {_ways('g', 'r,')}, st AS (SELECT r, i AS node, sum(w) AS s FROM g GROUP BY r, i), top AS (SELECT r, quantile_cont(s, 0.8) AS cut FROM st GROUP BY r),
be AS (SELECT st.r, st.node, any_value(s > cut)::INT AS hub, coalesce(sum(share), 0) / {(n - 1) * (n - 2)} AS v FROM st JOIN top USING (r) LEFT JOIN sh USING (r, node) GROUP BY st.r, st.node)
SELECT CAST(node AS INT) AS node, round(avg(hub), 5) AS hub_probability, round(avg(v), 5) AS betweenness_mean, round(stddev_pop(v), 5) AS betweenness_std, round(quantile_cont(v, 0.025), 5) AS betweenness_low, round(quantile_cont(v, 0.975), 5) AS betweenness_high FROM be GROUP BY node""",
        "communicability": f"WITH {_exponential(n)} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_interval('value')} FROM ex WHERE i <= j GROUP BY i, j",
        "communicability_nodes": f"WITH {_exponential(n)}, ro AS (SELECT r, i AS node, sum(value) AS v, sum(value) FILTER (i = j) AS own FROM ex GROUP BY r, i) SELECT CAST(node AS INT) AS node, {_interval('v')}, round(avg(own), 5) AS subgraph_mean, round(stddev_pop(own), 5) AS subgraph_std FROM ro GROUP BY node",
        "plot_communicability": f"WITH {_exponential(n)}, me AS MATERIALIZED (SELECT i, j, avg(value) AS v FROM ex WHERE i <= j GROUP BY i, j) SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(log10(v + 1e-10), 5) AS value, CASE WHEN i = j THEN (SELECT count(*) FROM me y WHERE y.i = y.j AND (round(y.v, 9) > round(me.v, 9) OR (round(y.v, 9) = round(me.v, 9) AND y.i <= me.i))) END AS place FROM me",
        "plot_metrics": f"WITH {cells} SELECT metric, r, round(value, 5) AS value, round(avg(value) OVER p, 5) AS mean, round(quantile_cont(value, 0.025) OVER p, 5) AS ci_low, round(quantile_cont(value, 0.975) OVER p, 5) AS ci_high FROM va WINDOW p AS (PARTITION BY metric)",
        "rewire_degrees": f"WITH {_matrix(n, STRONG)} SELECT CAST(t.null_id AS INT) AS null_id, CAST(node AS INT) AS node, CAST(d AS BIGINT) AS degree, round((SELECT sum(w) FROM half), 5) AS weight FROM k, range(3) t(null_id) WHERE d > 0",
        "ring_lattice": f"WITH {_matrix(n, STRONG)} SELECT CAST(node AS INT) AS node, CAST(2 * floor(floor((SELECT sum(d) FROM k) / {n}) / 2) AS BIGINT) AS degree, ((SELECT sum(d) FROM k) >= {2 * n})::INT AS near FROM k",
        "pls_bootstrap": _pls(100),
        "voxel_connectome": f"""WITH f AS ({_dti(15)}), tr AS (SELECT r, voxel % 5 AS p, abs(sum(value)) AS t FROM f WHERE c <= 3 GROUP BY r, voxel), pm AS (SELECT r, p, avg(t) AS t FROM tr GROUP BY r, p),
e AS (SELECT a.r, a.p AS i, z.p AS j, a.t + z.t AS w FROM pm a JOIN pm z ON a.r = z.r AND z.p = a.p + 1)
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, {_interval('w', 7)}, round(avg((w > 0)::INT), 7) AS p_nonzero FROM e GROUP BY i, j""",
        "nbs_fwer": f"WITH {_supra(100, 1.0)} SELECT component, size, round(p, 6) AS p FROM pv",
        "nbs_edges": f"WITH {_supra(100, 1.0)} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(t, 5) AS t, component, size, round(p, 6) AS p, p < 0.05 AS significant FROM up JOIN pv USING (component) WHERE perm = 0",
        "tfnbs": _tfnbs(5000),
        "hub_bootstrap": f"WITH {hub_runs} SELECT CAST(node AS INT) AS node, any_value(mo.hub_class) AS hub_class, round(avg((al.hub_class > 0)::INT), 5) AS hub_probability, round(any_value(stability), 5) AS stability, round(avg(z), 5) AS z_mean, round(stddev_pop(z), 5) AS z_std, round(avg(participation), 5) AS participation_mean, round(stddev_pop(participation), 5) AS participation_std, round(quantile_cont(participation, 0.025), 5) AS participation_low, round(quantile_cont(participation, 0.975), 5) AS participation_high FROM al JOIN mo USING (node) GROUP BY node",
        "rich_club_bootstrap": f"""WITH {_samples(20, n, True)}, kk AS MATERIALIZED (SELECT r, i AS node, sum((w > 0)::INT) AS d FROM g GROUP BY ALL), md AS (SELECT i AS node, count(DISTINCT j) AS d FROM g WHERE w > 0 GROUP BY i),
lv AS (SELECT unnest(range(CAST(floor(quantile_cont(d, 0.1) FILTER (d > 0)) AS BIGINT), CAST(floor(quantile_cont(d, 0.9)) AS BIGINT) + 1)) AS k FROM (SELECT coalesce(d, 0) AS d FROM range({n}) t(node) LEFT JOIN md USING (node))),
pr AS (SELECT lv.k, g.r, avg(w) AS phi FROM lv, g JOIN kk x ON x.r = g.r AND x.node = g.i JOIN kk y ON y.r = g.r AND y.node = g.j WHERE x.d > lv.k AND y.d > lv.k AND g.i < g.j GROUP BY lv.k, g.r),
ph AS (SELECT lv.k, coalesce(phi, 0.0) AS phi FROM lv CROSS JOIN range(20) t(run) LEFT JOIN pr ON pr.k = lv.k AND pr.r = t.run)
SELECT CAST(k AS INT) AS k, count(*) AS replicates, round(avg(phi), 5) AS phi_mean, round(stddev_pop(phi), 5) AS phi_std, round(quantile_cont(phi, 0.025), 5) AS phi_low, round(quantile_cont(phi, 0.975), 5) AS phi_high FROM ph GROUP BY k""",
        "rich_club_members": f"""WITH {_samples(20, n, True)}, kk AS (SELECT r, i AS node, sum((w > 0)::INT) AS d FROM g GROUP BY ALL), md AS (SELECT i AS node, count(DISTINCT j) AS d FROM g WHERE w > 0 GROUP BY i),
lv AS (SELECT floor(quantile_cont(d, 0.1) FILTER (d > 0)) AS low, floor(quantile_cont(d, 0.9)) AS high FROM (SELECT coalesce(d, 0) AS d FROM range({n}) t(node) LEFT JOIN md USING (node)))
SELECT CAST(node AS INT) AS node, avg((d > low + floor((high - low + 1) / 2))::INT) AS share FROM kk, lv GROUP BY node""",
        "graph_metrics_plain": f"WITH {cells} SELECT metric, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, round(quantile_cont(value, 0.025), 5) AS ci_low, round(quantile_cont(value, 0.975), 5) AS ci_high FROM va GROUP BY metric",
        "text_matrix": f"WITH {_matrix(n)} SELECT CAST(i AS INT) AS i, string_agg(printf('%.2f', w), chr(9) ORDER BY j) AS row FROM m GROUP BY i",
        "running_statistics": "SELECT event_type, count(value) AS n, round(sum(value) / count(value), 6) AS mean, round(var_pop(value), 6) AS var, round(sqrt(var_pop(value)), 6) AS std, round(avg((value > 0)::INT), 6) AS p_nonzero FROM events GROUP BY event_type",
    }
