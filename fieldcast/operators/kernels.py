"""Structured memory kernels and the rails of a model, in tasks, from one row of moments a field; models stay rows.

A kernel's first block and its memory can be free (full), share one profile of lags over all modes (shared), have a
profile for each mode of the one-step operator (modal), or a memory of low rank (reduced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions.linalg import companion, ridge, spectral_radius, symmetric
from fieldcast.functions.windows import numbered
from fieldcast.operators.dynamics import BLENDS, GAIN_CAP, _blended, forecast_gain, limit_gain, limit_radius, norm_budget, unpacked
from fieldcast.operators.horizons import iterated, left_over
from fieldcast.operators.moments import moments

STRUCTURES = ("full", "shared", "modal", "reduced")
#: The one-step fit takes quiet rows alone if there are so many at least, or four for each lag. Fixed value.
LEAST_QUIET = 32


def real_modes(a: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, complex]]]:
    """(P, modes) with a = P D P^-1 and D of real blocks: (place, size, eigenvalue), size 2 for a pair x + iy, whose block is
    [[x, y], [-y, x]]. Modes by falling size of the eigenvalue."""
    values, vectors = np.linalg.eig(a)
    order = [i for i in np.lexsort((values.real, -np.abs(values))) if values[i].imag >= -1e-12 * max(abs(values[i]), 1e-300)]
    columns, modes = [], []
    for i in order:
        v, pair = vectors[:, i], abs(values[i].imag) > 1e-12 * max(abs(values[i]), 1e-300)
        modes.append((len(columns), 1 + pair, complex(values[i]) if pair else complex(values[i].real)))
        columns += [v.real, v.imag] if pair else [v.real]
    return np.column_stack(columns), modes


def _block(c: complex) -> np.ndarray:
    return np.array([[c.real, c.imag], [-c.imag, c.real]])


class Moments:
    """Sums over a field's rows: zz of the stacked lags, uu and zu with the inputs, zy, uy, yy with the next state."""

    def __init__(self, n: int, m: np.ndarray, p: int, e: int):
        self.n, z, u, y = n, slice(0, p), slice(p, p + e), slice(p + e, None)
        self.zz, self.zu, self.zy = m[z, z], m[z, u], m[z, y]
        self.uu, self.uy, self.yy = m[u, u], m[u, y], m[y, y]
        self.k = len(self.yy)


def kernel(s: Moments, structure: str, mu: float, rank: int, increment: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """(blocks, coefficients by mode and lag, none but for shared and modal) of w[t+1] = sum_j A_j w[t-j].

    increment fits the step from w[t], so that the ridge pulls towards persistence, and puts the identity back.
    """
    k, lags = s.k, len(s.zz) // s.k
    at = lambda j: slice(j * k, (j + 1) * k)
    zy = s.zy - s.zz[:, :k] if increment else s.zy
    none = np.zeros((0, lags), complex)
    if structure == "full":
        g = ridge(s.zz, zy, mu).T
        blocks, coefficients = [g[:, at(j)] for j in range(lags)], none
    else:
        first = ridge(s.zz[:k, :k], zy[:k], mu).T
        if structure == "reduced":
            blocks, coefficients = [first], none
            if lags > 1:
                g = ridge(s.zz[k:, k:], zy[k:] - s.zz[k:, :k] @ first.T, mu).T
                u, d, vt = np.linalg.svd(g, full_matrices=False)
                low = (u[:, :rank] * d[:rank]) @ vt[:rank]
                blocks += [low[:, at(j)] for j in range(lags - 1)]
        else:
            # In modal coordinates, to which the sums are carried over, a kernel is a number for each mode and lag.
            p, modes = real_modes(first)
            inv = np.linalg.inv(p)
            zz = np.stack([[inv @ s.zz[at(i), at(j)] @ inv.T for j in range(lags)] for i in range(lags)])
            zy = np.stack([inv @ zy[at(i)] @ inv.T for i in range(lags)])
            if structure == "shared":
                value = np.concatenate([[v] * size for _, size, v in modes])
                gram = np.einsum("ijss,s->ij", zz, np.abs(value) ** 2)
                profile = np.linalg.solve(gram + mu * np.eye(lags), np.einsum("iss,s->i", zy, value.conj()).real)
                coefficients = np.array([profile * v for _, _, v in modes])
            else:
                coefficients = np.array([_mode_profile(zz, zy, x, size, mu) for x, size, _ in modes])
            blocks = []
            for j in range(lags):
                d = np.zeros((k, k))
                for (x, size, _), c in zip(modes, coefficients[:, j], strict=True):
                    d[x : x + size, x : x + size] = _block(c) if size == 2 else c.real
                blocks.append(p @ d @ inv)
    if increment:
        blocks[0] = blocks[0] + np.eye(k)
        coefficients = coefficients.copy()
        coefficients[:, 0] += 1
    return blocks, coefficients


def _mode_profile(zz: np.ndarray, zy: np.ndarray, x: int, size: int, mu: float) -> np.ndarray:
    """The weight of each lag of one mode; of a pair in the coordinate z = first - i second, on which D acts as a number."""
    if size == 1:
        return np.linalg.solve(zz[:, :, x, x] + mu * np.eye(len(zz)), zy[:, x, x]).astype(complex)
    a, b = x, x + 1
    gram = zz[:, :, a, a] + zz[:, :, b, b] + 1j * (zz[:, :, a, b] - zz[:, :, b, a])
    cross = zy[:, a, a] + zy[:, b, b] + 1j * (zy[:, b, a] - zy[:, a, b])
    return np.linalg.solve((gram + mu * np.eye(len(zz))).T, cross)


def fit_kernels(design: DataFrame, structure: str = "modal", mu: float = 1e-3, rank: int = 32, increment: bool = True, quiet: Column | None = None) -> DataFrame:
    """(field, k, lags, a, b, q, structure, coefficients, n_quiet, n): a model row for each field, see dynamics.fit_table.

    design: (field, t, x, y[, u]) of dynamics.delay_line. The kernel is fitted on the rows that quiet holds for, on all if
    these are fewer than LEAST_QUIET or four a lag, the input matrix then on what the kernel leaves of all rows.
    coefficients: real and imaginary part by mode and lag. Values that are not finite are an error.
    """
    if structure not in STRUCTURES:
        raise ValueError(f"structure {structure!r} is none of {', '.join(STRUCTURES)}")
    kind, u = dict(design.dtypes)["field"], F.col("u") if "u" in design.columns else F.array().cast("array<double>")
    calm = F.coalesce(quiet, F.lit(False)) if quiet is not None else F.lit(True)
    rows = design.select("field", calm.alias("calm"), F.concat("x", u, "y").alias("z"), F.size("x").alias("p"), F.size(u).alias("e"))
    schema = f"field {kind}, k int, lags int, a array<double>, b array<double>, q array<double>, structure string, coefficients array<double>, n_quiet long, n long"

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        p, e, size = int(f["p"].iloc[0]), int(f["e"].iloc[0]), len(f["sx"].iloc[0])
        parts = {bool(r.calm): (int(r.n), np.asarray(r.xx).reshape(size, size)) for r in f.itertuples()}
        if not all(np.isfinite(m).all() for _, m in parts.values()):
            raise ValueError(f"field {f['field'].iloc[0]}: states or inputs are not finite")
        every = Moments(sum(n for n, _ in parts.values()), sum(m for _, m in parts.values()), p, e)
        lags, n_quiet = p // every.k, parts.get(True, (0,))[0]
        stage = Moments(*parts[True], p, e) if n_quiet >= max(4 * lags, LEAST_QUIET) else every
        blocks, coefficients = kernel(stage, structure, mu, rank, increment)
        a = np.hstack(blocks)
        b = ridge(every.uu, every.uy - every.zu.T @ a.T, mu).T if e else np.zeros((every.k, 0))
        whole = np.block([[every.zz, every.zu], [every.zu.T, every.uu]])
        rest = left_over(np.hstack([a, b]), whole, np.vstack([every.zy, every.uy]), every.yy)
        q = symmetric(rest) / max(every.n - 1, 1) + 1e-8 * np.eye(every.k)
        flat = np.stack([coefficients.real, coefficients.imag], -1).ravel()
        return pd.DataFrame([(f["field"].iloc[0], every.k, lags, np.ravel(blocks), b.ravel(), q.ravel(), structure, flat, n_quiet, every.n)], columns=[c.split()[0] for c in schema.split(", ")])

    return moments(rows, ["field", "calm", "p", "e"], "z").groupBy("field").applyInPandas(solve, schema)


def memory_profile(models: DataFrame) -> DataFrame:
    """(field, mode, lag, weight, half_life): the size of each lag's weight in each mode, and the days in which the mode's slowest
    part halves (infinite if it does not). models: rows of fit_kernels that have coefficients."""
    kind = dict(models.dtypes)["field"]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                c = np.asarray(r.coefficients).reshape(-1, int(r.lags), 2)
                for i, alpha in enumerate(c[..., 0] + 1j * c[..., 1]):
                    size = np.abs(np.roots(np.r_[1, -alpha])).max(initial=0.0)
                    half = np.inf if size >= 1 else float(np.log(0.5) / np.log(size)) if size > 0 else 0.0
                    out += [(r.field, i, j, float(abs(x)), half) for j, x in enumerate(alpha)]
            yield pd.DataFrame(out, columns=["field", "mode", "lag", "weight", "half_life"])

    return models.mapInPandas(task, f"field {kind}, mode int, lag int, weight double, half_life double")


def tail_moments(design: DataFrame, share: float = 0.2) -> DataFrame:
    """(field, p, e, n, xx, ..): the moments of the last rows of a field's horizons.horizon_design, on which a blend is chosen."""
    last = numbered(design).where(F.col("nth") > F.col("n") * (1 - share))
    return moments(last.select("field", F.concat("x", "u", "y").alias("z"), F.size("x").alias("p"), F.size("u").alias("e")), ["field", "p", "e"], "z")


def tail_error(blocks: list[np.ndarray], b: np.ndarray, horizon: int, n: int, m: np.ndarray, p: int, e: int) -> float:
    """Root of the mean square of the iterated forecasts' errors over the tail's rows and all leads, from its moments."""
    k, ell, total = len(blocks[0]), e // horizon, 0.0
    for h, (theta, inputs, _) in enumerate(iterated(blocks, b if b.shape[1] == ell else np.zeros((k, ell)), horizon), 1):
        at, to = np.r_[0 : p + h * ell], slice(p + e + (h - 1) * k, p + e + h * k)
        total += float(np.trace(left_over(np.hstack([theta, inputs]), m[np.ix_(at, at)], m[at, to], m[to, to])))
    return float(np.sqrt(max(total, 0.0) / max(n * horizon, 1)))


def railed(models: DataFrame, horizon: int, tails: DataFrame | None = None, cap: float | None = GAIN_CAP, radius: float | None = 1.0) -> DataFrame:
    """models with held blocks and blend, gain, radius, error, error_persistence: rails as a step from model rows to model rows.

    tails (tail_moments of a design of this horizon): the blend with persistence of the least error there, among 21 whose gain is
    within the cap; persistence itself always is. With fewer than four rows there, or without tails, the largest blend
    within the cap, of 1 at most in the first case. Then all blocks are held to the spectral radius by one factor. A cap or
    radius of None holds nothing. Noise and inputs stay.
    """
    kind = dict(models.dtypes)["field"]
    names = [*models.columns, "blend", "gain", "radius", "error", "error_persistence"]
    schema = f"{', '.join(f'`{c}` {t}' for c, t in models.dtypes)}, blend double, gain double, radius double, error double, error_persistence double"

    def one(m: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in m.itertuples():
            a, b, _ = unpacked(r)
            blend, error, kept = 1.0, None, None
            tail = next(f.itertuples(), None)
            if tail is not None:
                x = np.asarray(tail.xx).reshape(len(tail.sx), -1)
                score = lambda blocks: tail_error(blocks, b, horizon, int(tail.n), x, int(tail.p), int(tail.e))  # noqa: B023, E731
                kept = score(_blended(a, 0.0))
            if tail is not None and tail.n >= 4:
                able = [s for s in BLENDS if not s or cap is None or forecast_gain(_blended(a, s), horizon) <= cap]
                error, blend = min((score(_blended(a, s)), s) for s in able)
                a = _blended(a, blend)
            elif cap is not None:
                a, blend = limit_gain(a, horizon, min(cap, 1.0) if tail is not None else cap)
            if radius is not None:
                a = limit_radius(a, radius)
            out.append((*r[1:], blend, forecast_gain(a, horizon), spectral_radius(companion(a)), error, kept))
            out[-1] = (*[np.ravel(a) if c == "a" else v for c, v in zip(names, out[-1], strict=True)],)
        return pd.DataFrame(out, columns=names)

    if tails is None:
        tails = models.sparkSession.createDataFrame([], f"field {kind}, p int, e int, n long, xx array<double>, sx array<double>")
    return models.groupBy("field").cogroup(tails.groupBy("field")).applyInPandas(one, schema)


def is_persistence(models: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(field, persistence, norm_budget): whether a model's blocks are the identity and zeros, and the sum of their norms."""
    kind = dict(models.dtypes)["field"]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(r.field, unpacked(r)[0]) for r in f.itertuples()]
            yield pd.DataFrame([(x, bool(np.abs(a[0] - np.eye(len(a[0]))).max() <= tolerance and all(np.abs(c).max() <= tolerance for c in a[1:])), norm_budget(a)) for x, a in got], columns=["field", "persistence", "norm_budget"])

    return models.mapInPandas(task, f"field {kind}, persistence boolean, norm_budget double")
