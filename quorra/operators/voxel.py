"""Signal-level bootstrap: constant projectors are computed once and shipped as a table; replicates stay lazy."""

from __future__ import annotations

from math import factorial, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quorra.plans.sql import Spark, Steps, run, values


def directions(count: int) -> np.ndarray:
    """Unit vectors on a Fibonacci sphere."""
    k = np.arange(count) + 0.5
    z = 1 - 2 * k / count
    turn = pi * (1 + sqrt(5)) * k
    return np.stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z], axis=1)


def gradients(count: int = 64, unweighted: int = 2, b: float = 1000.0) -> tuple[np.ndarray, np.ndarray]:
    return np.where(np.arange(count) < unweighted, 0.0, b), directions(count)


def tensor_design(bvals: np.ndarray, bvecs: np.ndarray) -> np.ndarray:
    """Columns: 1, then minus b times xx, yy, zz, 2xy, 2xz, 2yz."""
    x, y, z = bvecs.T
    return np.stack([np.ones_like(bvals), -bvals * x * x, -bvals * y * y, -bvals * z * z, -2 * bvals * x * y, -2 * bvals * x * z, -2 * bvals * y * z], axis=1)


def harmonics(bvecs: np.ndarray, lmax: int = 8) -> np.ndarray:
    """Real even-order spherical harmonics, (lmax + 1)(lmax + 2) / 2 columns, by the associated Legendre recurrence."""
    cos, phi = np.clip(bvecs[:, 2], -1, 1), np.arctan2(bvecs[:, 1], bvecs[:, 0])
    sin = np.sqrt(1 - cos * cos)
    legendre = {(0, 0): np.ones_like(cos)}
    for m in range(lmax + 1):
        if m:
            legendre[m, m] = -(2 * m - 1) * sin * legendre[m - 1, m - 1]
        for n in range(m + 1, lmax + 1):
            legendre[n, m] = ((2 * n - 1) * cos * legendre[n - 1, m] - (n + m - 1) * legendre.get((n - 2, m), 0)) / (n - m)
    columns = []
    for n in range(0, lmax + 1, 2):
        for m in range(-n, n + 1):
            k = abs(m)
            base = sqrt((2 * n + 1) / (4 * pi) * factorial(n - k) / factorial(n + k)) * legendre[n, k]
            columns.append(base if m == 0 else sqrt(2) * base * (np.sin(k * phi) if m < 0 else np.cos(k * phi)))
    return np.stack(columns, axis=1)


def response_diagonal(response: list[float], lmax: int = 8) -> np.ndarray:
    """The response's value of order l for each of its columns, 1 beyond the orders given."""
    return np.concatenate([np.full(2 * n + 1, response[n // 2] if n // 2 < len(response) else 1.0) for n in range(0, lmax + 1, 2)])


def _projector_steps(design: np.ndarray) -> Steps:
    inverse = np.linalg.pinv(design)
    return [
        ("projector", values([(c, g, float(inverse[c, g])) for c in range(inverse.shape[0]) for g in range(inverse.shape[1])], "c, g, p")),
        ("design", values([(g, c, float(design[g, c])) for g in range(design.shape[0]) for c in range(design.shape[1])], "g, c, x")),
    ]


def _masked(masked: bool) -> str:
    """Voxels to fit; those outside the mask keep coefficients of zero."""
    return "SELECT s.voxel, g, s FROM {signals} s JOIN {mask} m ON m.voxel = s.voxel WHERE m.inside = 1" if masked else "SELECT voxel, g, s FROM {signals}"


def _outside(masked: bool, dialect, replicates: int, columns: int, first: int) -> str:
    return f" UNION ALL SELECT r, voxel, cast(c AS int) AS c, 0.0 AS value FROM (SELECT voxel FROM {{mask}} WHERE inside = 0) m CROSS JOIN {dialect.series(replicates, 'r')} q CROSS JOIN {dialect.series(columns, 'c')} w WHERE c >= {first}" if masked else ""


def wild_steps(dialect, replicates: int, bvals: np.ndarray, bvecs: np.ndarray, masked: bool = False, estimator: str = "hc3", rademacher: bool = True, seed: int = 42) -> Steps:
    """Tensor coefficients (r, voxel, c, value) of {signals}(voxel, g, s): fit logs, flip leverage-scaled residuals, refit.

    masked: {mask}(voxel, inside) says which voxels are fitted; the others have coefficients of zero.
    """
    design = tensor_design(bvals, bvecs)
    leverage = np.einsum("gc,cg->g", design, np.linalg.pinv(design))
    scale = {"hc2": 1 / np.sqrt(1 - leverage), "hc3": 1 / (1 - leverage)}.get(estimator, np.ones_like(leverage))
    h = dialect.hashed(seed, "r", "voxel", "g")
    webb = "CASE {h} % 6 WHEN 0 THEN -sqrt(1.5) WHEN 1 THEN -1.0 WHEN 2 THEN -sqrt(0.5) WHEN 3 THEN sqrt(0.5) WHEN 4 THEN 1.0 ELSE sqrt(1.5) END".replace("{h}", h)
    flip = f"(2 * ({h} % 2) - 1)" if rademacher else webb
    return [
        *_projector_steps(design),
        ("scales", values([(g, float(s)) for g, s in enumerate(scale)], "g, k")),
        ("inside", _masked(masked)),
        ("logs", "SELECT voxel, g, ln(greatest(s, 1e-6)) AS y FROM inside"),
        ("fit", "SELECT voxel, c, sum(p * y) AS beta FROM logs JOIN projector ON projector.g = logs.g GROUP BY voxel, c"),
        ("fitted", "SELECT voxel, g, sum(x * beta) AS yhat FROM fit JOIN design ON design.c = fit.c GROUP BY voxel, g"),
        ("parts", "SELECT f.voxel, f.g, yhat, (y - yhat) * k AS e FROM fitted f JOIN logs l ON l.voxel = f.voxel AND l.g = f.g JOIN scales s ON s.g = f.g"),
        ("flipped", f"SELECT r, voxel, g, yhat + e * {flip} AS y FROM parts CROSS JOIN {dialect.series(replicates, 'r')} q"),
        ("out", "SELECT r, voxel, c, sum(p * y) AS value FROM flipped JOIN projector ON projector.g = flipped.g WHERE c > 0 GROUP BY r, voxel, c" + _outside(masked, dialect, replicates, 7, 1)),
    ]


def residual_steps(dialect, replicates: int, response: list[float], bvecs: np.ndarray, lmax: int = 8, masked: bool = False, seed: int = 42) -> Steps:
    """Deconvolved coefficients (r, voxel, c, value): residuals drawn again across gradients, refit, negatives cut to 0."""
    design, count = harmonics(bvecs, lmax) * response_diagonal(response, lmax)[None, :], len(bvecs)
    return [
        *_projector_steps(design),
        ("inside", _masked(masked)),
        ("fit", "SELECT voxel, c, sum(p * s) AS beta FROM inside l JOIN projector ON projector.g = l.g GROUP BY voxel, c"),
        ("fitted", "SELECT voxel, g, sum(x * beta) AS yhat FROM fit JOIN design ON design.c = fit.c GROUP BY voxel, g"),
        ("parts", "SELECT f.voxel, f.g, yhat, s - yhat AS e FROM fitted f JOIN inside l ON l.voxel = f.voxel AND l.g = f.g"),
        ("picked", f"SELECT r, voxel, g, yhat, {dialect.hashed(seed, 'r', 'voxel', 'g')} % {count} AS h FROM parts CROSS JOIN {dialect.series(replicates, 'r')} q"),
        ("drawn", "SELECT a.r, a.voxel, a.g, a.yhat + b.e AS y FROM picked a JOIN parts b ON b.voxel = a.voxel AND b.g = a.h"),
        ("out", "SELECT r, voxel, c, greatest(sum(p * y), 0.0) AS value FROM drawn JOIN projector ON projector.g = drawn.g GROUP BY r, voxel, c" + _outside(masked, dialect, replicates, design.shape[1], 0)),
    ]


def _inputs(signals: DataFrame, mask: DataFrame | None) -> dict[str, DataFrame]:
    return {"signals": signals} | ({"mask": mask} if mask is not None else {})


def wild_bootstrap_dti(signals: DataFrame, bvals: np.ndarray, bvecs: np.ndarray, mask: DataFrame | None = None, n_iterations: int = 50, estimator: str = "hc3", distribution: str = "rademacher", seed: int = 42) -> DataFrame:
    """(r, voxel, c, value) of signals(voxel, g, s) measured with the caller's gradients; mask(voxel, inside) is optional."""
    steps = wild_steps(Spark, n_iterations, np.asarray(bvals, dtype=float), np.asarray(bvecs, dtype=float), mask is not None, estimator, distribution == "rademacher", seed)
    return run(signals.sparkSession, steps, **_inputs(signals, mask))


def residual_bootstrap_csd(signals: DataFrame, bvecs: np.ndarray, response: list[float], mask: DataFrame | None = None, lmax: int = 8, n_iterations: int = 50, seed: int = 42) -> DataFrame:
    steps = residual_steps(Spark, n_iterations, response, np.asarray(bvecs, dtype=float), lmax, mask is not None, seed)
    return run(signals.sparkSession, steps, **_inputs(signals, mask))


def voxel_connectome(fields: DataFrame, track, nodes: int) -> DataFrame:
    """Edge statistics of the graphs that track(r, field rows) -> edges(i, j, w) makes of each replicate of fields.

    One replicate's field is one group, as tracking needs the whole field; replicates are spread over tasks.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r = int(pdf["r"].iloc[0])
        out = track(r, pdf)
        return pd.DataFrame({"r": r, "i": out["i"], "j": out["j"], "w": out["w"]})

    samples = fields.groupBy("r").applyInPandas(one, "r long, i int, j int, w double")
    steps = [
        ("x", "SELECT DISTINCT r FROM {samples}"),
        ("c", "SELECT DISTINCT i, j FROM {samples}"),
        ("d", "SELECT c.i, c.j, coalesce(s.w, 0.0) AS w FROM c CROSS JOIN x LEFT JOIN {samples} s ON s.r = x.r AND s.i = c.i AND s.j = c.j"),
        ("out", "SELECT i, j, avg(w) AS mean, stddev_pop(w) AS std, percentile(w, 0.025) AS ci_low, percentile(w, 0.975) AS ci_high, avg(CASE WHEN w > 0 THEN 1.0D ELSE 0.0D END) AS p_nonzero FROM d GROUP BY i, j"),
    ]
    return run(samples.sparkSession, steps, samples=samples)
