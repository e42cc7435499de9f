"""Statistics on small arrays: Student's t, Mann-Whitney, clustered least squares."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) and df > 0 else math.nan


@lru_cache(maxsize=512)
def t_quantile(p: float, df: float) -> float:
    """Upper quantile for p > 0.5, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_p_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def mann_whitney_greater(x, y) -> tuple[float, float]:
    """U of x and the one-sided p that x tends to be larger: exact if the smaller side has at most 8
    values and none are tied, else normal with tie and continuity correction."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n1, n2 = len(x), len(y)
    if not n1 or not n2:
        return math.nan, math.nan
    both = np.concatenate([x, y])
    order, ranks = np.argsort(both, kind="stable"), np.empty(n1 + n2)
    ranks[order] = np.arange(1, n1 + n2 + 1)
    values, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    ranks = (np.bincount(inverse, ranks) / counts)[inverse]
    u = float(ranks[:n1].sum() - n1 * (n1 + 1) / 2)
    if min(n1, n2) <= 8 and (counts == 1).all():
        ways = np.zeros(n1 * n2 + 1)
        ways[0] = 1.0
        for i in range(1, n1 + 1):  # Gaussian binomial coefficients: multiply by (1 - q^(n2 + i)) / (1 - q^i)
            top = ways.copy()
            top[n2 + i :] -= ways[: len(ways) - n2 - i] if n2 + i < len(ways) else 0
            for j in range(i, len(top)):
                top[j] += top[j - i]
            ways = top
        return u, float(ways[math.ceil(u - 1e-9) :].sum() / ways.sum())
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - float((counts**3 - counts).sum()) / (n * (n - 1))))
    z = (u - n1 * n2 / 2 - 0.5) / sd if sd else math.nan
    return u, 0.5 * math.erfc(z / math.sqrt(2))


def design(log2k: np.ndarray, structural: np.ndarray, logfreq: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(log2k)), log2k, structural, log2k * structural, logfreq])


def clustered_ols(y: np.ndarray, x: np.ndarray, groups: np.ndarray, small: bool = True, normal_ci: bool = False) -> dict:
    """Least squares with standard errors clustered by group.

    ``small`` adds (n - 1) / (n - p) to G / (G - 1); ``normal_ci`` takes 1.96 instead of t's quantile.
    Singular designs are solved by the pseudo-inverse; a single cluster has no standard error.
    """
    y, x = np.asarray(y, float), np.asarray(x, float)
    n, p = x.shape
    bread = np.linalg.pinv(x.T @ x)
    coef = bread @ (x.T @ y)
    e = y - x @ coef
    codes = np.unique(groups, return_inverse=True)[1]
    g = int(codes.max()) + 1 if n else 0
    sums = np.zeros((g, p))
    np.add.at(sums, codes, x * e[:, None])
    scale = math.nan if g < 2 or (small and n <= p) else g / (g - 1) * ((n - 1) / (n - p) if small else 1)
    se = np.sqrt(np.maximum(np.diag(bread @ (sums.T @ sums) @ bread), 0) * scale)
    total = float(((y - y.mean()) ** 2).sum()) if n else 0.0
    q = math.nan if g < 2 else 1.96 if normal_ci else t_quantile(0.975, g - 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
    return {
        "coef": coef, "se": se, "lo": coef - q * se, "hi": coef + q * se, "p": np.array([t_p_two_sided(v, g - 1) for v in t]),
        "r2": 1 - float(e @ e) / total if total else math.nan, "rss": float(e @ e), "n": n, "g": g,
    }
