"""Sequential graph kernels: one small graph a group, NumPy inside applyInPandas; replicates are the parallel axis."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(edges: pd.DataFrame, nodes: int) -> np.ndarray:
    out = np.zeros((nodes, nodes))
    np.add.at(out, (edges["i"].to_numpy(), edges["j"].to_numpy()), edges["w"].to_numpy())
    out += out.T
    np.fill_diagonal(out, 0)
    return out


def rng(*parts: object) -> np.random.Generator:
    """The same stream for the same parts wherever a task runs."""
    return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big"))


def shortest(weights: np.ndarray) -> np.ndarray:
    """All-pairs path lengths, an edge being 1 / weight long, by repeated min-plus squaring; infinite if apart."""
    far = np.full(weights.shape, np.inf)
    far[weights > 0] = 1 / weights[weights > 0]
    np.fill_diagonal(far, 0)
    for _ in range(max(1, int(np.ceil(np.log2(max(2, len(far))))))):
        far = (far[:, :, None] + far[None, :, :]).min(axis=1)
    return far


def efficiency(weights: np.ndarray, zero_absent: bool = False) -> float:
    """Mean inverse path length; zero_absent takes absent edges as length 0 and pairs at length 0 as nothing."""
    n = len(weights)
    if n < 2:
        return 0.0
    if zero_absent:
        far = np.divide(1.0, weights, out=np.zeros_like(weights), where=weights > 0)
        for _ in range(max(1, int(np.ceil(np.log2(n))))):
            far = (far[:, :, None] + far[None, :, :]).min(axis=1)
    else:
        far = shortest(weights)
    off = far[~np.eye(n, dtype=bool)]
    return float(np.divide(1.0, off, out=np.zeros_like(off), where=off > 0).sum() / (n * (n - 1)))


def local_efficiency(weights: np.ndarray, zero_absent: bool = False) -> np.ndarray:
    out = np.zeros(len(weights))
    for node, row in enumerate(weights):
        near = np.flatnonzero(row)
        if len(near) >= 2:
            out[node] = efficiency(weights[np.ix_(near, near)], zero_absent)
    return out


def path_length(weights: np.ndarray) -> float:
    far = shortest(weights)
    some = far[np.isfinite(far) & (far > 0)]
    return float(some.mean()) if len(some) else float("inf")


def clustering(weights: np.ndarray) -> float:
    k = (weights > 0).sum(axis=1)
    root = np.cbrt(weights)
    walks = np.einsum("ij,jk,ki->i", root, root, root)
    some = k >= 2
    return float((walks[some] / (k[some] * (k[some] - 1))).mean()) if some.any() else 0.0


def transitivity(weights: np.ndarray) -> float:
    k, root = (weights > 0).sum(axis=1), np.cbrt(weights)
    triples = float((k * (k - 1)).sum())
    return float(np.einsum("ij,jk,ki->", root, root, root)) / triples if triples else 0.0


def louvain(weights: np.ndarray, resolution: float = 1.0, seed: int = 42, sweeps: int = 50) -> np.ndarray:
    """Local moving in random node order until a sweep moves nothing; labels from 0; ties go to the lowest label.

    The gain of a community is its weight to the node less resolution * strength * total / 2m, without the loss of
    leaving, so moves may alternate up to the limit of sweeps.
    """
    n, total = len(weights), weights.sum()
    label = np.arange(n)
    if total <= 0:
        return label
    strength, draw = weights.sum(axis=1), rng("louvain", seed)
    mass = strength.copy()
    for _ in range(sweeps):
        moved = False
        for v in draw.permutation(n):
            to = np.bincount(label, weights=weights[v], minlength=n)
            here = label[v]
            options = np.unique(label)
            options = options[options != here]
            if not len(options):
                continue
            gain = to[options] - resolution * strength[v] * mass[options] / total
            best = int(np.argmax(gain))
            if gain[best] > 0:
                mass[here] -= strength[v]
                label[v] = options[best]
                mass[options[best]] += strength[v]
                moved = True
        if not moved:
            break
    return np.unique(label, return_inverse=True)[1]


def modularity(weights: np.ndarray, label: np.ndarray) -> float:
    total = weights.sum()
    if total <= 0:
        return 0.0
    member = np.eye(label.max() + 1)[label]
    inside, mass = np.einsum("ic,ij,jc->c", member, weights, member), member.T @ weights.sum(axis=1)
    return float((inside / total - (mass / total) ** 2).sum())


def rewire(weights: np.ndarray, per_edge: int = 10, draw: np.random.Generator | None = None) -> np.ndarray:
    """Degree-preserving swaps of edge pairs (weights travel along): per_edge attempts an edge."""
    out, draw = weights.copy(), draw or rng("rewire")
    ends = np.argwhere(np.triu(out, 1) > 0)
    if len(ends) < 2:
        return out
    for _ in range(per_edge * len(ends)):
        x, y = draw.choice(len(ends), 2, replace=False)
        (a, b), (c, d) = ends[x], ends[y]
        if draw.random() < 0.5:
            c, d = d, c
        if len({int(a), int(b), int(c), int(d)}) < 4 or out[a, d] or out[c, b]:
            continue
        for old, new in (((a, b), (a, d)), ((c, d), (c, b))):
            out[new] = out[new[::-1]] = out[old]
            out[old] = out[old[::-1]] = 0
        ends[x], ends[y] = (a, d), (c, b)
    return out


def ring_lattice(weights: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Each node tied to its next neighbours on a ring, as many edges as fit; weights drawn from those given."""
    n = len(weights)
    pool = weights[weights > 0]
    out = np.zeros_like(weights)
    for step in range(1, max(1, len(pool) // n) // 2 + 1):
        at = np.arange(n)
        out[at, (at + step) % n] = out[(at + step) % n, at] = draw.choice(pool, n)
    return out


def betweenness(weights: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Share of shortest paths through each node, over ordered pairs, divided by (n - 1)(n - 2)."""
    far, n = shortest(weights), len(weights)
    direct = np.full(weights.shape, np.inf)
    direct[weights > 0] = 1 / weights[weights > 0]
    paths = np.zeros((n, n))  # number of shortest paths, filled by rising distance
    for s in range(n):
        paths[s, s] = 1
        for v in np.argsort(far[s], kind="stable"):
            if v != s and np.isfinite(far[s, v]):
                last = np.abs(far[s] + direct[:, v] - far[s, v]) < tolerance  # an infinite sum is never near
                paths[s, v] = paths[s, last].sum()
    out = np.zeros(n)
    for v in range(n):
        on = np.isfinite(far)
        on[on] = np.abs((far[:, v][:, None] + far[v][None, :])[on] - far[on]) < tolerance
        on[v, :] = on[:, v] = False
        np.fill_diagonal(on, False)
        through = np.outer(paths[:, v], paths[v])
        out[v] = (through[on] / paths[on]).sum()
    return out / max(1, (n - 1) * (n - 2))


def communicability(weights: np.ndarray, normalize: bool = True) -> np.ndarray:
    """Matrix exponential of the symmetric weights, divided by the largest absolute eigenvalue if normalize."""
    values, vectors = np.linalg.eigh(weights)
    top = np.abs(values).max(initial=0)
    if normalize and top > 0:
        values = values / top
    return (vectors * np.exp(values)) @ vectors.T


def components(pairs: np.ndarray, nodes: int) -> np.ndarray:
    """Label of each node: the smallest node it is connected with."""
    label = np.arange(nodes)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def tfnbs_scores(t: np.ndarray, extent: float = 0.5, height: float = 2.0, step: float = 0.1) -> np.ndarray:
    """Threshold-free scores: over rising thresholds, component size ** extent * h ** height * step, signed as t."""
    out, top = np.zeros_like(t), np.abs(t).max(initial=0)
    for h in np.arange(step, top + step, step) if top > 0 else ():
        pairs = np.argwhere(np.triu(np.abs(t) > h, 1))
        if not len(pairs):
            continue
        label = components(pairs, len(t))[pairs[:, 0]]
        size = np.bincount(label, minlength=len(t))[label]
        add = np.sign(t[pairs[:, 0], pairs[:, 1]]) * size**extent * h**height * step
        out[pairs[:, 0], pairs[:, 1]] += add
        out[pairs[:, 1], pairs[:, 0]] += add
    return out


def small_world(weights: np.ndarray, draw: np.random.Generator, n_random: int = 20, n_lattice: int = 20) -> tuple[float, float, float, float, float]:
    """(propensity, clustering, path length, both deviations) against rewired and lattice graphs."""
    c, length = clustering(weights), path_length(weights)
    null = [rewire(weights, 5, draw) for _ in range(n_random)]
    ring = [ring_lattice(weights, draw) for _ in range(n_lattice)]
    finite = lambda x: float(np.mean([v for v in x if np.isfinite(v)] or [0.0]))
    c_null, c_ring = finite(map(clustering, null)), finite(map(clustering, ring))
    l_null, l_ring = finite(map(path_length, null)), finite(map(path_length, ring))
    ratio = lambda a, b: float(np.clip(a / b, 0, 1)) if abs(b) > 1e-10 else 0.0
    dc, dl = ratio(c_ring - c, c_ring - c_null), ratio(length - l_null, l_ring - l_null)
    return 1 - float(np.sqrt((dc**2 + dl**2) / 2)), c, length, dc, dl


def _grouped(edges: DataFrame, key: str, schema: str, kernel) -> DataFrame:
    """kernel(key value, edges of the group) for each group; a group is one replicate's small graph."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value = pdf[key].iloc[0]
        return pd.DataFrame([(value, *row) for row in kernel(int(value), pdf)], columns=[key, *names])

    return edges.groupBy(key).applyInPandas(run, f"{key} long, {schema}")


def global_metrics(samples: DataFrame, nodes: int, compat: bool = False, seed: int = 42) -> DataFrame:
    """(r, metric, value) for each replicate of samples(r, i, j, w): efficiency, clustering, path length, modularity."""

    def kernel(r, pdf):
        m = matrix(pdf, nodes)
        yield "density", float((m > 0).sum() / (nodes * (nodes - 1)))
        yield "mean_strength", float(m.sum(axis=1).mean())
        yield "strength_std", float(m.sum(axis=1).std())
        yield "global_efficiency", efficiency(m, compat)
        yield "clustering", clustering(m)
        yield "transitivity", transitivity(m)
        yield "local_efficiency", float(local_efficiency(m, compat).mean())
        yield "path_length", path_length(m)
        yield "modularity", modularity(m, louvain(m, seed=seed + r))

    return _grouped(samples, "r", "metric string, value double", kernel)


def nodal_metrics(samples: DataFrame, nodes: int, compat: bool = False) -> DataFrame:
    """(r, node, strength, local_efficiency, betweenness)."""

    def kernel(r, pdf):
        m = matrix(pdf, nodes)
        yield from zip(range(nodes), m.sum(axis=1).tolist(), local_efficiency(m, compat).tolist(), betweenness(m).tolist(), strict=True)

    return _grouped(samples, "r", "node int, strength double, local_efficiency double, betweenness double", kernel)


def metric_summary(values: DataFrame, keys: list[str], ci: float = 0.95) -> DataFrame:
    """mean, population std and percentile interval of value by keys."""
    return values.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.percentile("value", (1 - ci) / 2).alias("ci_low"), F.percentile("value", (1 + ci) / 2).alias("ci_high"))


def partitions(samples: DataFrame, nodes: int, resolution: float = 1.0, seed: int = 42) -> DataFrame:
    """(r, node, community, modularity): one Louvain partition a replicate."""

    def kernel(r, pdf):
        m = matrix(pdf, nodes)
        label = louvain(m, resolution, seed + r)
        q = modularity(m, label)
        yield from ((k, int(c), q) for k, c in enumerate(label))

    return _grouped(samples, "r", "node int, community int, modularity double", kernel)


def consensus(coassigned: DataFrame, nodes: int, seed: int = 42) -> DataFrame:
    """(node, community, stability) of coassignment(i, j, p): Louvain on the co-assignment, stability its row maximum."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = matrix(pdf.rename(columns={"p": "w"}), nodes)
        return pd.DataFrame({"node": np.arange(nodes, dtype=np.int32), "community": louvain(m, seed=seed + 999).astype(np.int32), "stability": m.max(axis=1)})

    return coassigned.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "node int, community int, stability double")


def communicability_cells(samples: DataFrame, nodes: int, normalize: bool = True) -> DataFrame:
    """(r, i, j, value): the communicability of each pair, the diagonal being subgraph centrality."""

    def kernel(r, pdf):
        c = communicability(matrix(pdf, nodes), normalize)
        yield from ((i, j, float(c[i, j])) for i in range(nodes) for j in range(i, nodes))

    return _grouped(samples, "r", "i int, j int, value double", kernel)


def communicability_nodes(cells: DataFrame) -> DataFrame:
    """(node, mean, std, ci_low, ci_high, subgraph_mean, subgraph_std) of communicability_cells: row sums with the diagonal, and the diagonal."""
    ends = cells.select("r", F.col("i").alias("node"), "value", (F.col("i") == F.col("j")).alias("own")).unionByName(cells.where("i != j").select("r", F.col("j").alias("node"), "value", F.lit(False).alias("own")))
    rows = ends.groupBy("r", "node").agg(F.sum("value").alias("value"), F.sum(F.when(F.col("own"), F.col("value"))).alias("own"))
    subgraph = rows.groupBy("node").agg(F.avg("own").alias("subgraph_mean"), F.stddev_pop("own").alias("subgraph_std"))
    return metric_summary(rows, ["node"]).join(subgraph, "node")


def small_world_propensity(samples: DataFrame, nodes: int, n_random: int = 20, n_lattice: int = 20, seed: int = 42) -> DataFrame:
    """(r, phi, clustering, path_length, delta_c, delta_l): a row a replicate."""

    def kernel(r, pdf):
        yield small_world(matrix(pdf, nodes), rng("small-world", seed, r), n_random, n_lattice)

    return _grouped(samples, "r", "phi double, clustering double, path_length double, delta_c double, delta_l double", kernel)


def small_world_summary(values: DataFrame) -> DataFrame:
    """(metric, mean, std, ci_low, ci_high) over the replicates of small_world_propensity."""
    names = [c for c in values.columns if c != "r"]
    pairs = ", ".join(f"'{c}', {c}" for c in names)
    return metric_summary(values.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value)"), ["metric"])


def rewired(samples: DataFrame, nodes: int, n_random: int = 1, per_edge: int = 10, seed: int = 42) -> DataFrame:
    """(r, null_id, i, j, w): rewired copies of each replicate's graph."""

    def kernel(r, pdf):
        for k in range(n_random):
            m = rewire(matrix(pdf, nodes), per_edge, rng("rewire", seed, r, k))
            yield from ((k, int(i), int(j), float(m[i, j])) for i, j in np.argwhere(np.triu(m, 1) > 0))

    return _grouped(samples, "r", "null_id int, i int, j int, w double", kernel)


def degree_range(samples: DataFrame, nodes: int) -> tuple[int, int]:
    """From the 10th percentile of the positive degrees to the 90th of all, whole numbers, of the mean graph (edges of any replicate)."""
    edges = samples.where("w > 0").select("i", "j").distinct()
    ends = edges.select(F.col("i").alias("node")).unionByName(edges.select(F.col("j").alias("node"))).groupBy("node").agg(F.count("*").alias("k"))
    degree = np.zeros(nodes)
    for r in ends.collect():  # a row a node
        degree[r["node"]] = r["k"]
    return (int(np.percentile(degree[degree > 0], 10)), int(np.percentile(degree, 90))) if degree.any() else (0, -1)


def _phi(m: np.ndarray, k: int) -> float:
    rich = np.flatnonzero((m > 0).sum(axis=1) > k)
    return float(np.triu(m[np.ix_(rich, rich)], 1).sum() / (len(rich) * (len(rich) - 1) / 2)) if len(rich) >= 2 else 0.0


def rich_club_normalized(samples: DataFrame, nodes: int, n_random: int = 20, levels: tuple[int, int] | None = None, seed: int = 42) -> DataFrame:
    """(r, k, phi, phi_norm): mean weight among nodes of degree above k, over that of rewired graphs (made once a replicate)."""
    low, high = levels or degree_range(samples, nodes)

    def kernel(r, pdf):
        m = matrix(pdf, nodes)
        null = [rewire(m, 10, rng("rich-club", seed, r, k)) for k in range(n_random)]
        for k in range(low, high + 1):
            base, value = float(np.mean([_phi(x, k) for x in null] or [0.0])), _phi(m, k)
            yield k, value, value / base if base > 0 else 0.0

    return _grouped(samples, "r", "k int, phi double, phi_norm double", kernel)


def rich_club_summary(values: DataFrame) -> DataFrame:
    """(k, replicates, phi_mean, phi_std, phi_low, phi_high, norm_mean, norm_std, norm_low, norm_high) of rich_club_normalized."""
    out = [F.count("*").alias("replicates")]
    for name, c in (("phi", "phi"), ("norm", "phi_norm")):
        out += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.percentile(c, 0.025).alias(f"{name}_low"), F.percentile(c, 0.975).alias(f"{name}_high")]
    return values.groupBy("k").agg(*out)


def rich_club_members(samples: DataFrame, nodes: int, k: int) -> DataFrame:
    """(node, share): share of replicates in which a node's degree is above k."""

    def kernel(r, pdf):
        yield from enumerate((((matrix(pdf, nodes) > 0).sum(axis=1) > k) * 1.0).tolist())

    return _grouped(samples, "r", "node int, rich double", kernel).groupBy("node").agg(F.avg("rich").alias("share"))


def hub_samples(samples: DataFrame, nodes: int, community: list[int] | None = None, percentile: float = 80.0, seed: int = 42) -> DataFrame:
    """(r, node, strength, betweenness, participation, z, hub_class) for each replicate.

    community: the nodes' communities (one small list); without it every replicate has its own Louvain partition. A hub's
    strength is above the percentile; provincial 1, connector 2, kinless 3 by participation, others 0.
    """

    def kernel(r, pdf):
        m = matrix(pdf, nodes)
        label = np.unique(community, return_inverse=True)[1] if community is not None else louvain(m, seed=seed + r)
        strength, member = m.sum(axis=1), np.eye(label.max() + 1)[label]
        toward = m @ member
        share = np.divide(toward, strength[:, None], out=np.zeros_like(toward), where=strength[:, None] > 0)
        part = 1 - (share**2).sum(axis=1)
        inside = (toward * member).sum(axis=1)
        size, mean = member.sum(axis=0), (member * inside[:, None]).sum(axis=0) / np.maximum(member.sum(axis=0), 1)
        spread = np.sqrt((member * (inside[:, None] - mean) ** 2).sum(axis=0) / np.maximum(size, 1))[label]
        z = np.divide(inside - mean[label], spread, out=np.zeros(nodes), where=(spread > 1e-12) & (size[label] > 1))
        hub = np.where(strength <= np.percentile(strength, percentile), 0, np.where(part < 0.3, 1, np.where(part < 0.75, 2, 3)))
        yield from zip(range(nodes), strength.tolist(), betweenness(m).tolist(), part.tolist(), z.tolist(), hub.tolist(), strict=True)

    return _grouped(samples, "r", "node int, strength double, betweenness double, participation double, z double, hub_class int", kernel)


def hub_summary(values: DataFrame) -> DataFrame:
    """By node: hub_probability, hub_class (the commonest, the smallest of ties), stability, means, deviations and intervals."""
    counts = values.groupBy("node", "hub_class").agg(F.count("*").alias("n"))
    modal = counts.groupBy("node").agg(F.max(F.struct("n", -F.col("hub_class"))).alias("top"), F.sum("n").alias("runs"))
    modal = modal.select("node", (-F.col("top").getField("col2")).alias("hub_class"), (F.col("top.n") / F.col("runs")).alias("stability"))
    out = [F.avg((F.col("hub_class") > 0).cast("double")).alias("hub_probability"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std")]
    for c in ("betweenness", "participation"):
        out += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.percentile(c, 0.025).alias(f"{c}_low"), F.percentile(c, 0.975).alias(f"{c}_high")]
    return values.groupBy("node").agg(*out).join(modal, "node")


def community_detection(samples: DataFrame, nodes: int, n_runs: int = 100, classes: DataFrame | None = None, resolution: float = 1.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(partitions, consensus) of the first n_runs replicates: Louvain on each, co-assignment, Louvain on that.

    classes(i, j, label) keeps the edges of label 3 and above only. partitions has the modularity of its run, from which
    plotdata.community_spread gives the distributions.
    """
    from quorra.operators.graph import coassignment

    some = samples.where(F.col("r") < n_runs)
    if classes is not None:
        some = some.join(classes.where("label >= 3").select("i", "j"), ["i", "j"], "left_semi")
    found = partitions(some, nodes, resolution, seed)
    return found, consensus(coassignment(found.select("r", "node", "community")), nodes, seed)


def supra_components(tests: DataFrame, nodes: int, threshold: float = 3.0, tail: str = "both", key: str = "perm") -> DataFrame:
    """(perm, component, size) of tests(perm, i, j, t): components of edges beyond the threshold, size in edges."""
    beyond = {"both": F.abs("t") > threshold, "left": F.col("t") < -threshold, "right": F.col("t") > threshold}[tail]

    def kernel(value, pdf):
        pairs = pdf[["i", "j"]].to_numpy()
        label = components(pairs, nodes)[pairs[:, 0]]
        yield from ((int(c), int(n)) for c, n in zip(*np.unique(label, return_counts=True), strict=True))

    return _grouped(tests.where(beyond), key, "component int, size long", kernel)


def _t_matrix(pdf: pd.DataFrame, nodes: int) -> np.ndarray:
    t = np.zeros((nodes, nodes))
    t[pdf["i"], pdf["j"]] = t[pdf["j"], pdf["i"]] = pdf["t"]
    return t


def tfnbs(tests: DataFrame, nodes: int, extent: float = 0.5, height: float = 2.0, step: float = 0.1, key: str = "perm") -> DataFrame:
    """(perm, i, j, score) of tests(perm, i, j, t)."""

    def kernel(value, pdf):
        s = tfnbs_scores(_t_matrix(pdf, nodes), extent, height, step)
        yield from ((int(i), int(j), float(s[i, j])) for i, j in np.argwhere(np.triu(s, 1) != 0))

    return _grouped(tests, key, "i int, j int, score double", kernel)


def tfnbs_largest(tests: DataFrame, nodes: int, extent: float = 0.5, height: float = 2.0, step: float = 0.1, key: str = "perm") -> DataFrame:
    """(perm, top): the largest |score| of each test of tests(perm, i, j, t), of which nothing else leaves its task."""

    def kernel(value, pdf):
        yield (float(np.abs(tfnbs_scores(_t_matrix(pdf, nodes), extent, height, step)).max(initial=0)),)

    return _grouped(tests, key, "top double", kernel)


def tfnbs_tested(subject_edges: DataFrame, nodes: int, n_permutations: int = 5000, extent: float = 0.5, height: float = 2.0, step: float = 0.1, seed: int = 42) -> DataFrame:
    """(i, j, score, p, significant): p is the share of relabellings whose largest |score| is as large; edges of score 0 have p 1 and no row.

    subject_edges is read several times: callers save what is costly to make.
    """
    tests = permuted_tests(subject_edges, n_permutations, seed)
    scores = tfnbs(tests.where("perm = 0"), nodes, extent, height, step)
    return _against(scores.drop("perm"), tfnbs_largest(tests.where("perm > 0"), nodes, extent, height, step), "score", n_permutations)


def _against_largest(found: DataFrame, value: str, permutations: int) -> DataFrame:
    """The rows of perm 0 with p: the share of relabellings whose largest |value| is as large."""
    largest = found.where("perm > 0").groupBy("perm").agg(F.max(F.abs(value)).alias("top"))
    return _against(found.where("perm = 0").drop("perm"), largest, value, permutations)


def _against(rows: DataFrame, largest: DataFrame, value: str, permutations: int) -> DataFrame:
    """rows with p: the share of relabellings whose top in largest(perm, top) is as large as |value|. One number a relabelling is gathered."""
    tops = largest.agg(F.collect_list(F.round("top", 9)).alias("tops"))
    p = F.size(F.filter("tops", lambda x: x >= F.round(F.abs(F.col(value)), 9))) / F.lit(permutations)
    return rows.crossJoin(F.broadcast(tops)).withColumn("p", p).withColumn("significant", F.col("p") < 0.05).drop("tops")


def permuted_tests(subject_edges: DataFrame, permutations: int, seed: int = 42) -> DataFrame:
    """(perm, i, j, t): the Welch test of every relabelling; perm 0 is the true one."""
    from quorra.operators.inference import permuted_steps, ttest_steps
    from quorra.plans.sql import Spark, run

    perms = run(subject_edges.sparkSession, permuted_steps(Spark, permutations, seed), subject_edges=subject_edges)
    moved = subject_edges.join(perms, "subject").select("perm", "subject", F.col("g").alias("grp"), "i", "j", "w")
    # the groups' sizes are the same for every relabelling; those of the true one
    steps = [(n, q if n != "sizes" else q + " WHERE perm = 0") for n, q in ttest_steps("{moved}", "perm")]
    return run(subject_edges.sparkSession, steps, moved=moved).select("perm", "i", "j", F.round("t", 9).alias("t"))


def nbs(subject_edges: DataFrame, nodes: int, threshold: float = 3.0, n_permutations: int = 5000, tail: str = "both", seed: int = 42) -> DataFrame:
    """(component, size, p): observed components with family-wise p, the share of relabellings whose largest is as large."""
    found = supra_components(permuted_tests(subject_edges, n_permutations, seed), nodes, threshold, tail)
    return _against_largest(found, "size", n_permutations).drop("significant")


def nbs_edges(subject_edges: DataFrame, nodes: int, threshold: float = 3.0, n_permutations: int = 5000, tail: str = "both", seed: int = 42) -> DataFrame:
    """(i, j, t, component, size, p, significant): the edges of every observed component with its p."""
    tests = permuted_tests(subject_edges, n_permutations, seed)
    tested = nbs(subject_edges, nodes, threshold, n_permutations, tail, seed)
    beyond = {"both": F.abs("t") > threshold, "left": F.col("t") < -threshold, "right": F.col("t") > threshold}[tail]

    def kernel(value, pdf):
        label = components(pdf[["i", "j"]].to_numpy(), nodes)
        yield from ((int(i), int(j), float(t), int(label[i])) for i, j, t in zip(pdf["i"], pdf["j"], pdf["t"], strict=True))

    edges = _grouped(tests.where("perm = 0").where(beyond), "perm", "i int, j int, t double, component int", kernel).drop("perm")
    return edges.join(tested, "component").withColumn("significant", F.col("p") < 0.05)


def pls_covariances(features: DataFrame, behaviors: DataFrame, n_permutations: int, n_bootstrap: int, seed: int = 42) -> DataFrame:
    """(n, kind, feature, var, c): centred X'Y of the data (kind data), of permuted behaviours and of resampled subjects.

    Sums by aggregation: no task or driver holds the subjects by features.
    """
    from pyspark.sql.window import Window

    from quorra.plans.sql import Spark

    draws = features.sparkSession.range(0, 1 + n_permutations + n_bootstrap).withColumnRenamed("id", "n")
    kind = F.when(F.col("n") == 0, "data").when(F.col("n") <= n_permutations, "perm").otherwise("boot")
    nth = F.row_number().over(Window.orderBy("subject")) - 1  # subjects of a cohort
    people = behaviors.select("subject").distinct().withColumn("k", nth).withColumn("size", F.count("*").over(Window.partitionBy()))
    each = people.crossJoin(draws.withColumn("kind", kind)).withColumn("hash", F.expr(Spark.hashed(seed, "n", "k")))  # subjects by replicates
    place = F.row_number().over(Window.partitionBy("n").orderBy("hash", "k")) - 1
    each = each.withColumn("to", F.when(F.col("kind") == "data", F.col("k")).when(F.col("kind") == "perm", place).otherwise(F.pmod("hash", F.col("size"))))
    names = people.select(F.col("k").alias("to"), F.col("subject").alias("other"))
    each = each.join(names, "to")
    # a permutation gives subject k the behaviour of another; a resample takes both from another
    pairs = each.select("n", "kind", "size", F.when(F.col("kind") == "boot", F.col("other")).otherwise(F.col("subject")).alias("x_of"), F.col("other").alias("y_of"))
    pairs = pairs.groupBy("n", "kind", "size", "x_of", "y_of").agg(F.count("*").alias("m"))
    y = pairs.join(behaviors.withColumnRenamed("subject", "y_of"), "y_of")
    y = y.join(y.groupBy("n", "var").agg((F.sum(F.col("m") * F.col("y")) / F.max("size")).alias("mean")), ["n", "var"])
    y = y.select("n", "kind", "var", "x_of", (F.col("m") * (F.col("y") - F.col("mean"))).alias("y"))
    # the behaviours are centred, so the features need not be
    joined = y.join(features.withColumnRenamed("subject", "x_of"), "x_of")
    return joined.groupBy("n", "kind", "feature", "var").agg(F.sum(F.col("x") * F.col("y")).alias("c"))


def _decomposed(pdf: pd.DataFrame, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, u, s, v) of one covariance table; the largest |u| of a component is positive."""
    table = pdf.pivot(index="feature", columns="var", values="c").fillna(0.0).sort_index()
    u, s, v = np.linalg.svd(table.to_numpy(), full_matrices=False)
    u, s, v = u[:, :components], s[:components], v[:components]
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    sign = np.where(sign == 0, 1, sign)
    return table.index.to_numpy(), u * sign, s, (v.T * sign).T


def pls(features: DataFrame, behaviors: DataFrame, n_components: int = 5, n_permutations: int = 200, n_bootstrap: int = 200, seed: int = 42) -> DataFrame:
    """(component, singular_value, explained, p, n_reliable) of features(subject, feature, x) and behaviors(subject, var, y).

    A subject without a feature has zero there.
    """
    values, weights = pls_tables(features, behaviors, n_components, n_permutations, n_bootstrap, seed)
    reliable = weights.groupBy("component").agg(F.count_if(F.abs("ratio") > 2).alias("n_reliable"))
    return values.join(reliable, "component")


def pls_tables(features: DataFrame, behaviors: DataFrame, n_components: int = 5, n_permutations: int = 200, n_bootstrap: int = 200, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(component, singular_value, explained, p) and (component, feature, weight, ratio): ratio is weight over its bootstrap deviation.

    Every replicate's features by behaviours is one small matrix in one task. The data's weights, features by
    components, go to every task; explained is of the components kept.
    """
    made = pls_covariances(features, behaviors, n_permutations, n_bootstrap, seed)
    base = made.where("kind = 'data'").select("feature", "var", "c").toPandas()
    feature, u0, s0, _ = _decomposed(base, n_components)
    k = len(s0)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f, u, s, _ = _decomposed(pdf, k)
        if pdf["kind"].iloc[0] == "perm":
            return pd.DataFrame({"kind": "perm", "component": np.arange(len(s)), "feature": -1, "v": s})
        whole = np.zeros_like(u0)
        whole[np.searchsorted(feature, f)] = u
        a, _, b = np.linalg.svd(whole.T @ u0)
        turned = whole @ (a @ b)
        return pd.DataFrame({"kind": "boot", "component": np.repeat(np.arange(k), len(feature)), "feature": np.tile(feature, k), "v": turned.T.ravel()})

    made = made.where("kind != 'data'").groupBy("n").applyInPandas(run, "kind string, component int, feature long, v double")
    spark = features.sparkSession
    values = spark.createDataFrame([(c, float(s0[c]), float(s0[c] ** 2 / max((s0**2).sum(), 1e-300))) for c in range(k)], "component int, singular_value double, explained double")
    above = made.where("kind = 'perm'").join(F.broadcast(values), "component")
    p = above.groupBy("component").agg((F.count_if(F.col("v") >= F.col("singular_value")) / F.lit(n_permutations)).alias("p"))
    weights = spark.createDataFrame([(c, int(feature[f]), float(u0[f, c])) for c in range(k) for f in range(len(feature))], "component int, feature long, weight double")
    spread = made.where("kind = 'boot'").groupBy("component", "feature").agg(F.stddev_pop("v").alias("se"))
    ratio = F.when(F.col("se") > 0, F.col("weight") / F.col("se")).otherwise(0.0)
    return values.join(p, "component"), weights.join(spread, ["component", "feature"]).select("component", "feature", "weight", ratio.alias("ratio"))
