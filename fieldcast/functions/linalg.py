"""Small dense algebra on model matrices: NumPy, no Spark."""

from __future__ import annotations

import math

import numpy as np


def ridge(zz: np.ndarray, zy: np.ndarray, mu: float) -> np.ndarray:
    """Solves (zz + mu I) x = zy."""
    return np.linalg.solve(zz + mu * np.eye(len(zz)), zy)


def symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


def spectral_radius(a: np.ndarray) -> float:
    return float(np.abs(np.linalg.eigvals(a)).max()) if len(a) else 0.0


def companion(blocks: list[np.ndarray]) -> np.ndarray:
    """The one-step matrix of w[t+1] = sum_j A_j w[t-j] on stacked lags, newest first."""
    r, n = len(blocks[0]), len(blocks)
    out = np.zeros((n * r, n * r))
    out[:r] = np.hstack(blocks)
    out[r:, : (n - 1) * r] = np.eye((n - 1) * r)
    return out


def chi2_sf(x: float, dof: float) -> float:
    """The upper tail of chi-square: the regularised incomplete gamma function, by series or continued fraction."""
    a, x = dof / 2, x / 2
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        for _ in range(10_000):
            n += 1
            term *= x / n
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - lead * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (d * an + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, lead * h)
