"""Group inference as relations: permutations are a column, implicit zeros are put back before any statistic."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quorra.plans.sql import Spark, Steps, run


def ttest_steps(table: str = "{subject_edges}", key: str = "") -> Steps:
    """Welch t per edge, group 1 minus group 2; subjects without the edge count as zero. key: a column that tells tests apart.

    Squares are taken about the mean of the subjects that have the edge, so that nearly equal weights don't cancel; the zeros of
    the others are added to them. t is 0 where a group has fewer than two subjects.
    """
    k = f"{key}, " if key else ""
    own = lambda g: f"CASE WHEN grp = {g} THEN w END"
    moments = ", ".join(f"count({own(g)}) AS c{g}, coalesce(avg({own(g)}), 0.0) AS a{g}, coalesce(var_pop({own(g)}), 0.0) AS v{g}" for g in (1, 2))
    error = lambda g: f"c{g} * (v{g} + a{g} * a{g} * (n{g} - c{g}) / n{g}) / nullif(n{g} - 1, 0) / n{g}"
    return [
        ("sizes", f"SELECT nullif(cast(count(DISTINCT CASE WHEN grp = 1 THEN subject END) AS double), 0) AS n1, nullif(cast(count(DISTINCT CASE WHEN grp = 2 THEN subject END) AS double), 0) AS n2 FROM {table}"),
        ("moments", f"SELECT {k}i, j, {moments} FROM {table} GROUP BY {k}i, j"),
        ("errors", f"SELECT {k}i, j, a1 * c1 / n1 AS m1, a2 * c2 / n2 AS m2, {error(1)} + {error(2)} AS v FROM moments CROSS JOIN sizes"),
        ("ttest", f"SELECT {k}i, j, m1 - m2 AS diff, CASE WHEN v > 1e-18 THEN (m1 - m2) / sqrt(v) ELSE 0.0 END AS t FROM errors"),
    ]


def edge_ttest(subject_edges: DataFrame) -> DataFrame:
    return run(subject_edges.sparkSession, ttest_steps(), subject_edges=subject_edges)


def subject_samples_steps(dialect, replicates: int, seed: int = 42) -> Steps:
    """subject_samples(subject, grp, r, i, j, w): Poisson resamples of each subject's {subject_lines}(sid, subject, grp, a, b, w)."""
    u = f"(({dialect.hashed(seed, 'r', 'sid')} + 0.5) / 4294967296.0)"
    total, term, count = 0.0, 0.36787944117144233, []
    for k in range(13):
        total += term
        count.append(f"(CASE WHEN u > {total!r} THEN 1 ELSE 0 END)")
        term /= k + 1
    return [
        ("picked", f"SELECT r, subject, grp, a, b, w, {u} AS u FROM {{subject_lines}} CROSS JOIN {dialect.series(replicates, 'r')} x WHERE a <> b"),
        ("subject_samples", f"SELECT subject, grp, r, least(a, b) AS i, greatest(a, b) AS j, sum(w * ({' + '.join(count)})) / 1e6 AS w FROM picked GROUP BY subject, grp, r, least(a, b), greatest(a, b)"),
    ]


def nbs_stability_steps(dialect, replicates: int, threshold: float, rounds: int = 100, tail: str = "both", seed: int = 42, table: str = "{subject_samples}") -> Steps:
    """(i, j, freq): share of rounds in which an edge lies in a supra-threshold component; a round takes one sample of each subject.

    The table has replicates 0 to replicates - 1 for every subject. An edge beyond the threshold is always in
    a component, so that the components themselves need not be found.
    """
    beyond = {"both": f"abs(t) > {threshold}", "left": f"t < -{threshold}", "right": f"t > {threshold}"}[tail]
    return [
        ("members", f"SELECT DISTINCT subject FROM {table}"),
        ("chosen", f"SELECT round, subject, {dialect.hashed(seed, 'round', 'subject')} % {replicates} AS r FROM members CROSS JOIN {dialect.series(rounds, 'round')} x"),
        ("drawn", f"SELECT c.round, s.subject, grp, i, j, w FROM chosen c JOIN {table} s ON s.subject = c.subject AND s.r = c.r"),
        *ttest_steps("drawn", "round"),
        ("out", f"SELECT i, j, cast(sum(CASE WHEN {beyond} THEN 1 ELSE 0 END) AS double) / {rounds} AS freq FROM (SELECT i, j, round(t, 9) AS t FROM ttest) q GROUP BY i, j"),
    ]


def nbs_stability(subject_samples: DataFrame, replicates: int, threshold: float = 3.0, rounds: int = 100, tail: str = "both", seed: int = 42) -> DataFrame:
    """rounds is cut to the smaller group's size, which callers pass."""
    return run(subject_samples.sparkSession, nbs_stability_steps(Spark, replicates, threshold, rounds, tail, seed), subject_samples=subject_samples)


def permuted_steps(dialect, permutations: int, seed: int = 42) -> Steps:
    """perms(perm, subject, g): perm 0 is the true grouping; others relabel subjects in order of a hash."""
    return [
        ("subjects", "SELECT subject, max(grp) AS grp FROM {subject_edges} GROUP BY subject"),
        ("first", "SELECT count(CASE WHEN grp = 1 THEN 1 END) AS n1, count(CASE WHEN grp = 2 THEN 1 END) AS n2 FROM subjects"),
        ("ranked", f"SELECT perm, subject, grp, row_number() OVER (PARTITION BY perm ORDER BY {dialect.hashed(seed, 'perm', 'subject')}, subject) AS rk FROM subjects CROSS JOIN {dialect.series(permutations + 1, 'perm')} p"),
        ("perms", "SELECT perm, subject, CASE WHEN perm = 0 THEN grp WHEN rk <= n1 THEN 1 ELSE 2 END AS g FROM ranked CROSS JOIN first"),
    ]


def permuted_diffs_steps(dialect, permutations: int, seed: int = 42) -> Steps:
    return [
        *permuted_steps(dialect, permutations, seed),
        ("diffs", "SELECT perm, i, j, round(sum(CASE WHEN g = 1 THEN w / n1 ELSE -w / n2 END), 9) AS d FROM perms JOIN {subject_edges} e ON e.subject = perms.subject CROSS JOIN first GROUP BY perm, i, j"),
    ]


def permutation_edges_steps(dialect, permutations: int, correction: str = "fdr", seed: int = 42, n_nodes: int = 25) -> Steps:
    pairs = n_nodes * (n_nodes - 1) // 2
    corrected = {
        "fdr": f"least(1.0, min(p * {pairs}.0 / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))",
        "bonferroni": f"least(1.0, p * {pairs})",
        "none": "p",
    }[correction]
    return [
        *permuted_diffs_steps(dialect, permutations, seed),
        ("p_values", f"SELECT a.i, a.j, max(a.d) AS diff, cast(sum(CASE WHEN abs(b.d) >= abs(a.d) THEN 1 ELSE 0 END) AS double) / {permutations} AS p FROM diffs a JOIN diffs b ON a.i = b.i AND a.j = b.j AND b.perm > 0 WHERE a.perm = 0 GROUP BY a.i, a.j"),
        ("ordered", "SELECT *, row_number() OVER (ORDER BY p, i, j) AS rk FROM p_values"),
        ("spread", "SELECT i, j, greatest(sum(CASE WHEN grp = 1 THEN w * w ELSE 0.0 END) - sum(CASE WHEN grp = 1 THEN w ELSE 0.0 END) * sum(CASE WHEN grp = 1 THEN w ELSE 0.0 END) / max(n1), 0.0) + greatest(sum(CASE WHEN grp = 2 THEN w * w ELSE 0.0 END) - sum(CASE WHEN grp = 2 THEN w ELSE 0.0 END) * sum(CASE WHEN grp = 2 THEN w ELSE 0.0 END) / max(n2), 0.0) AS ss, max(n1) + max(n2) - 2 AS v FROM {subject_edges} CROSS JOIN first GROUP BY i, j"),
        ("out", f"SELECT o.i, o.j, diff, p, {corrected} AS p_corrected, CASE WHEN ss > 1e-18 THEN diff / sqrt(ss / v) ELSE 0.0 END AS d FROM ordered o JOIN spread s ON s.i = o.i AND s.j = o.j"),
    ]


def permutation_test_edges(subject_edges: DataFrame, n_permutations: int = 10000, correction: str = "fdr", seed: int = 42, n_nodes: int = 25) -> DataFrame:
    """(i, j, diff, p, p_corrected, d); absent edges have p 1 and stand last in the correction over all pairs. d is Cohen's."""
    return run(subject_edges.sparkSession, permutation_edges_steps(Spark, n_permutations, correction, seed, n_nodes), subject_edges=subject_edges)


def total_weight_steps() -> Steps:
    return [("metric", "SELECT subject, round(sum(w), 6) AS x FROM {subject_edges} GROUP BY subject")]


def permutation_global_steps(dialect, permutations: int, seed: int = 42, metric: Steps | None = None) -> Steps:
    """(diff, p, d) of any scalar of a subject: metric's last step gives metric(subject, x). It is computed once a subject; scalars are permuted.

    metric has a row for every subject, zeros included. d is 0 where the pooled deviation is 0 or two subjects have none.
    """
    return [
        *permuted_steps(dialect, permutations, seed),
        *(metric if metric is not None else total_weight_steps()),
        ("diffs", "SELECT perm, round(avg(CASE WHEN g = 1 THEN x END) - avg(CASE WHEN g = 2 THEN x END), 8) AS delta FROM perms JOIN metric m ON m.subject = perms.subject GROUP BY perm"),
        ("pooled", "SELECT sqrt((var_pop(CASE WHEN g = 1 THEN x END) * count(CASE WHEN g = 1 THEN 1 END) + var_pop(CASE WHEN g = 2 THEN x END) * count(CASE WHEN g = 2 THEN 1 END)) / nullif(count(*) - 2, 0)) AS sd FROM perms JOIN metric m ON m.subject = perms.subject WHERE perm = 0"),
        ("out", f"SELECT a.delta AS diff, cast(sum(CASE WHEN abs(b.delta) >= abs(a.delta) THEN 1 ELSE 0 END) AS double) / {permutations} AS p, CASE WHEN max(sd) > 0 THEN a.delta / max(sd) ELSE 0.0 END AS d FROM diffs a JOIN diffs b ON b.perm > 0 CROSS JOIN pooled WHERE a.perm = 0 GROUP BY a.delta"),
    ]


def permutation_test_global(subject_edges: DataFrame, metric: DataFrame | None = None, n_permutations: int = 5000, seed: int = 42) -> DataFrame:
    """metric(subject, x) is the caller's scalar of each subject; without it, the total weight."""
    own = [("metric", "SELECT subject, x FROM {scalars}")] if metric is not None else None
    more = {"scalars": metric} if metric is not None else {}
    return run(subject_edges.sparkSession, permutation_global_steps(Spark, n_permutations, seed, own), subject_edges=subject_edges, **more)


def permutation_null_steps(dialect, permutations: int, seed: int = 42) -> Steps:
    """(perm, delta): the null distribution itself."""
    return [*permutation_global_steps(dialect, permutations, seed)[:-2], ("out", "SELECT perm, delta FROM diffs WHERE perm > 0")]


def cpm_steps(dialect, bootstraps: int, r_cut: float, seed: int = 42) -> Steps:
    """Predictions of all subjects from bagged models: edges with |r| above the critical value, summed by sign, one line."""
    return [
        ("members", "SELECT subject, value, row_number() OVER (ORDER BY subject) - 1 AS k, count(*) OVER () AS n FROM {behavior}"),
        ("bag", f"SELECT r, {dialect.hashed(seed, 'r', 'k')} % n AS k, count(*) AS m FROM members CROSS JOIN {dialect.series(bootstraps, 'r')} x GROUP BY 1, 2"),
        ("inbag", "SELECT r, subject, value, m, n FROM bag JOIN members ON members.k = bag.k"),
        ("base", "SELECT r, sum(m * value) AS sy, sum(m * value * value) AS syy, max(n) AS n FROM inbag GROUP BY r"),
        ("sums", "SELECT b.r, e.i, e.j, sum(m * w) AS sx, sum(m * w * w) AS sxx, sum(m * w * value) AS sxy FROM inbag b JOIN {subject_edges} e ON e.subject = b.subject GROUP BY b.r, e.i, e.j"),
        ("cors", "SELECT s.r, i, j, CASE WHEN n * sxx - sx * sx > 1e-9 AND n * syy - sy * sy > 1e-9 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0.0 END AS c FROM sums s JOIN base ON base.r = s.r"),
        ("score", f"SELECT c.r, e.subject, sum(CASE WHEN c > 0 THEN w ELSE -w END) AS x FROM cors c JOIN {{subject_edges}} e ON e.i = c.i AND e.j = c.j WHERE abs(c) > {r_cut!r} GROUP BY c.r, e.subject"),
        ("grid", f"SELECT r, subject, value FROM members CROSS JOIN {dialect.series(bootstraps, 'r')} x"),
        ("complete", "SELECT g.r, g.subject, coalesce(x, 0.0) AS x, coalesce(m, 0) AS m, g.value FROM grid g LEFT JOIN score s ON s.r = g.r AND s.subject = g.subject LEFT JOIN inbag b ON b.r = g.r AND b.subject = g.subject"),
        ("lines", "SELECT r, cast(sum(m) AS double) AS n, sum(m * x) AS sx, sum(m * x * x) AS sxx, sum(m * value) AS sy, sum(m * x * value) AS sxy FROM complete GROUP BY r"),
        ("guess", "SELECT subject, value, CASE WHEN n * sxx - sx * sx > 1e-9 THEN (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n + (n * sxy - sx * sy) / (n * sxx - sx * sx) * x ELSE x END AS y FROM complete JOIN lines ON lines.r = complete.r"),
        ("out", f"SELECT subject, max(value) AS actual, avg(y) AS predicted, {dialect.quantile('y', 0.025)} AS ci_low, {dialect.quantile('y', 0.975)} AS ci_high FROM guess GROUP BY subject"),
    ]


def cpm_summary_steps(dialect, bootstraps: int, r_cut: float, seed: int = 42) -> Steps:
    """(r, n, edges_positive, edges_negative): correlation of bagged predictions with the truth, mean numbers of edges, cut to whole ones."""
    steps = cpm_steps(dialect, bootstraps, r_cut, seed)
    return [
        *steps[:-1],
        ("predictions", steps[-1][1]),
        ("kept", f"SELECT r, sum(CASE WHEN c > {r_cut!r} THEN 1 ELSE 0 END) AS up, sum(CASE WHEN c < -{r_cut!r} THEN 1 ELSE 0 END) AS down FROM cors GROUP BY r"),
        ("edges_kept", "SELECT cast(floor(avg(up)) AS bigint) AS edges_positive, cast(floor(avg(down)) AS bigint) AS edges_negative FROM kept"),
        ("spreads", "SELECT count(*) AS n, covar_pop(predicted, actual) AS c, var_pop(predicted) * var_pop(actual) AS v FROM predictions"),
        ("out", "SELECT CASE WHEN v > 0 THEN c / sqrt(v) END AS r, n, edges_positive, edges_negative FROM spreads CROSS JOIN edges_kept"),
    ]


def predictive_model(subject_edges: DataFrame, behavior: DataFrame, n_bootstrap: int = 200, edge_threshold: float = 0.01, seed: int = 42) -> DataFrame:
    """(subject, actual, predicted, ci_low, ci_high); the cut-off correlation follows from the number of subjects, which is counted."""
    from quorra.functions.special import critical_r

    cut = critical_r(behavior.count(), edge_threshold)
    return run(subject_edges.sparkSession, cpm_steps(Spark, n_bootstrap, cut, seed), subject_edges=subject_edges, behavior=behavior)


def predictive_model_summary(subject_edges: DataFrame, behavior: DataFrame, n_bootstrap: int = 200, edge_threshold: float = 0.01, seed: int = 42) -> dict:
    """r and its p-value (0 and 1 with two subjects or fewer), mean numbers of edges."""
    from quorra.functions.special import critical_r, pearson_p_value

    cut = critical_r(behavior.count(), edge_threshold)
    row = run(subject_edges.sparkSession, cpm_summary_steps(Spark, n_bootstrap, cut, seed), subject_edges=subject_edges, behavior=behavior).first()
    enough = row["n"] > 2 and row["r"] is not None
    return {"r": row["r"] if enough else 0.0, "p": pearson_p_value(row["r"], row["n"]) if enough else 1.0, "edges_positive": row["edges_positive"], "edges_negative": row["edges_negative"]}


def pls_single_steps() -> Steps:
    """PLS with one behaviour: the singular vector is the normalized covariance, closed form."""
    return [
        ("centre", "SELECT avg(value) AS my, count(*) AS n FROM {behavior}"),
        ("cov", "SELECT i, j, sum(w * (value - my)) AS c FROM {subject_edges} e JOIN {behavior} b ON b.subject = e.subject CROSS JOIN centre GROUP BY i, j"),
        ("norm", "SELECT sqrt(sum(c * c)) AS s FROM cov"),
        ("out", "SELECT i, j, c / s AS weight, s AS singular_value FROM cov CROSS JOIN norm"),
    ]


def pls_single(subject_edges: DataFrame, behavior: DataFrame) -> DataFrame:
    return run(subject_edges.sparkSession, pls_single_steps(), subject_edges=subject_edges, behavior=behavior)


def pls_scores_steps() -> Steps:
    """(subject, brain, behaviour): scores of the first latent variable with one behaviour."""
    return [
        *pls_single_steps()[:-1],
        ("weights", "SELECT i, j, c / s AS weight FROM cov CROSS JOIN norm"),
        ("means", "SELECT e.i, e.j, sum(w) / max(n) AS m FROM {subject_edges} e CROSS JOIN centre GROUP BY e.i, e.j"),
        ("shift", "SELECT sum(weight * m) AS base FROM weights JOIN means ON means.i = weights.i AND means.j = weights.j"),
        ("raw", "SELECT e.subject, sum(weight * w) AS x FROM {subject_edges} e JOIN weights g ON g.i = e.i AND g.j = e.j GROUP BY e.subject"),
        ("out", "SELECT b.subject, coalesce(x, 0.0) - base AS brain, value - my AS behaviour FROM {behavior} b LEFT JOIN raw ON raw.subject = b.subject CROSS JOIN shift CROSS JOIN centre"),
    ]


def pls_scores(subject_edges: DataFrame, behavior: DataFrame) -> DataFrame:
    return run(subject_edges.sparkSession, pls_scores_steps(), subject_edges=subject_edges, behavior=behavior)
