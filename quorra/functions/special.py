"""Distribution functions in plain Python."""

from __future__ import annotations

from math import exp, lgamma, log, sqrt
from statistics import NormalDist


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a


def t_p_value(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def pearson_p_value(r: float, n: int) -> float:
    if n < 3 or abs(r) >= 1:
        return 0.0 if n >= 3 else 1.0
    return t_p_value(r * sqrt((n - 2) / (1 - r * r)), n - 2)


def critical_r(n: int, p: float) -> float:
    """The correlation whose two-sided p-value is p."""
    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if pearson_p_value(mid, n) > p else (low, mid)
    return round(high, 12)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)
