"""Linear memory models of state vectors: designs, fits from moments, rails, horizon families.

weights: (field, t, date, observed, w); forcing: (field, t or date, u array<double>).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.functions.linalg import companion, ridge, spectral_radius, symmetric
from fieldcast.functions.vectors import dot
from fieldcast.functions.windows import numbered, over_days
from fieldcast.operators.moments import moments

#: Weights of the persistence blend that are tried, and the largest gain allowed. Fixed values.
BLENDS, GAIN_CAP = tuple(i / 20 for i in range(21)), 2.0


def delay_line(weights: DataFrame, lags: int, horizon: int = 1, forcing: str | None = None) -> DataFrame:
    """(field, t, x, y[, u]): x stacks w at t .. t - lags + 1, y is w at t + horizon, u the inputs t .. t + horizon - 1.

    Only rows whose whole window, t - lags + 1 .. t + horizon, is in the calendar and observed. A row a day; long fields
    are cut into blocks of days.
    """

    def columns(w):
        span = w.rowsBetween(-(lags - 1), horizon)
        cols = {
            "x": F.flatten(F.array(*[F.lag("w", j).over(w) if j else F.col("w") for j in range(lags)])),
            "y": F.lead("w", horizon).over(w),
            "ok": (F.min(F.col("observed").cast("int")).over(span) == 1) & (F.count("*").over(span) == lags + horizon),
        }
        if forcing:
            cols["u"] = F.flatten(F.array(*[F.lead(forcing, j).over(w) if j else F.col(forcing) for j in range(horizon)]))
        return cols

    return over_days(weights, columns, lags - 1, horizon).where("ok").select("field", "t", "x", "y", *(["u"] if forcing else []))


def fit_table(design: DataFrame, mu: float = 1e-3, forced: bool = False, increment: bool = False) -> DataFrame:
    """(field, k, lags, a, b, q): the models of fit_operator as rows, matrices row by row; nothing reaches the driver."""
    z = design.withColumn("z", F.concat("x", "u") if forced else F.col("x"))
    sized = z.select("field", F.concat("z", "y").alias("zy"), F.size("x").alias("p"), F.size("z").alias("q"), F.size("y").alias("k"))
    kind = dict(design.dtypes)["field"]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                m = np.asarray(r.xx).reshape(len(r.sx), -1)
                p, q, k = int(r.p), int(r.q), int(r.k)
                zz, zy, yy = m[:q, :q], m[:q, q:], m[q:, q:]
                if increment:
                    zy, yy = zy - zz[:, :k], yy - zy[:k] - zy[:k].T + zz[:k, :k]
                theta = ridge(zz, zy, mu).T
                res = yy - theta @ zy - (theta @ zy).T + theta @ zz @ theta.T
                if increment:
                    theta[:, :k] += np.eye(k)
                if not np.isfinite(theta).all():
                    raise ValueError(f"field {r.field}: the fit is not finite")
                blocks = [theta[:, j * k : (j + 1) * k] for j in range(p // k)]
                out.append((r.field, k, p // k, np.ravel(blocks), theta[:, p:].ravel(), (symmetric(res) / max(r.n - 1, 1) + 1e-8 * np.eye(k)).ravel()))
            yield pd.DataFrame(out, columns=["field", "k", "lags", "a", "b", "q"])

    sums = moments(sized, ["field", "p", "q", "k"], "zy")
    return sums.mapInPandas(solve, f"field {kind}, k int, lags int, a array<double>, b array<double>, q array<double>")


def unpacked(r) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(A blocks, B, Q) of a row of fit_table."""
    k = int(r.k)
    return list(np.asarray(r.a).reshape(int(r.lags), k, k)), np.asarray(r.b).reshape(k, -1), np.asarray(r.q).reshape(k, k)


def fit_operator(design: DataFrame, mu: float = 1e-3, forced: bool = False, increment: bool = False) -> dict:
    """{field: (A blocks, B, Q)} of y = A x (+ B u) by ridge from one pass of moments; Q is the residual covariance plus jitter.

    increment fits y - w[t] and adds the identity back to the first block. For few fields: many stay in fit_table.
    """
    return {r.field: unpacked(r) for r in fit_table(design, mu, forced, increment).collect()}


def two_stage(design: DataFrame, quiet: Column, mu: float = 1e-3, lags: int = 1) -> dict:
    """{field: (A blocks, B)}: A from a field's rows that quiet holds for, all if these are fewer than max(4 lags, 32), B
    from the residuals of all its rows."""
    enough = F.coalesce(F.count_if(quiet).over(Window.partitionBy("field")), F.lit(0)) >= max(4 * lags, 32)
    calm = design.withColumns({"calm": F.coalesce(quiet, F.lit(False)), "enough": enough}).where("calm or not enough").drop("calm", "enough")
    first = fit_operator(calm, mu)
    blocks = {f: np.hstack(a) for f, (a, _, _) in first.items()}
    out = {}
    for r in moments(design.withColumn("all", F.concat("x", "u", "y")), ["field"], "all").collect():
        a = blocks[r.field]
        k, p = a.shape
        m = np.asarray(r.xx).reshape(len(r.sx), -1)
        u = slice(p, len(m) - k)
        b = ridge(m[u, u], m[u, len(m) - k :] - m[u, :p] @ a.T, mu).T
        out[r.field] = (first[r.field][0], b)
    return out


def shared_lag_weights(blocks_moments: tuple[np.ndarray, np.ndarray], k: int, lags: int, mu: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(A, alpha) of y = A sum_j alpha_j w[t-j], alternately solved from the moments (zz, zy) of the stacked lags; alpha_0 is 1."""
    zz, zy = blocks_moments
    alpha = np.r_[1.0, np.zeros(lags - 1)]
    a = np.eye(k)
    for _ in range(rounds):
        s = np.kron(alpha[:, None], np.eye(k))
        a = ridge(s.T @ zz @ s, s.T @ zy, mu).T
        g = np.array([[np.trace(a @ zz[i * k : (i + 1) * k, j * k : (j + 1) * k] @ a.T) for j in range(lags)] for i in range(lags)])
        c = np.array([np.trace(a @ zy[i * k : (i + 1) * k]) for i in range(lags)])
        new = np.linalg.solve(g + mu * np.eye(lags), c)
        new = new / new[0] if abs(new[0]) > 1e-12 else alpha
        if np.abs(new - alpha).max() < 1e-10:
            break
        alpha = new
    return a, alpha


def modal_kernel(zz: np.ndarray, zy: np.ndarray, k: int, lags: int, mu: float = 1e-3) -> list[np.ndarray]:
    """Blocks of a kernel that is diagonal in the modal basis of the one-step operator: an autoregression for each mode."""
    a0 = ridge(zz[:k, :k], zy[:k], mu).T
    values, v = np.linalg.eig(a0)
    inv = np.linalg.inv(v)
    out = [np.zeros((k, k), complex) for _ in range(lags)]
    for m in range(k):
        row = inv[m]
        g = np.array([[row @ zz[i * k : (i + 1) * k, j * k : (j + 1) * k] @ row.conj() for j in range(lags)] for i in range(lags)])
        c = np.array([row.conj() @ zy[i * k : (i + 1) * k] @ row for i in range(lags)])
        coef = np.linalg.solve(g.T + mu * np.eye(lags), c)
        for j in range(lags):
            out[j] += coef[j] * np.outer(v[:, m], inv[m])
    return [b.real for b in out]


def reduced_rank_tail(blocks: list[np.ndarray], rank: int) -> list[np.ndarray]:
    """The first block as it is, the later ones as their best approximation of the given rank together."""
    tail = np.hstack(blocks[1:])
    u, s, vt = np.linalg.svd(tail, full_matrices=False)
    low = (u[:, :rank] * s[:rank]) @ vt[:rank]
    k = len(blocks[0])
    return [blocks[0], *[low[:, j * k : (j + 1) * k] for j in range(len(blocks) - 1)]]


def koopman_modes(a: np.ndarray, step: float = 1.0) -> pd.DataFrame:
    """frequency and growth of each eigenvalue of a one-step operator."""
    log = np.log(np.linalg.eigvals(a).astype(complex)) / step
    return pd.DataFrame({"frequency": np.abs(log.imag) / (2 * math.pi), "growth": log.real}).sort_values(["growth", "frequency"], ascending=False, ignore_index=True)


def clip_eigenvalues(a: np.ndarray, most: float = 1.0) -> np.ndarray:
    values, v = np.linalg.eig(a)
    size = np.abs(values)
    return (v * (values * np.where(size > most, most / np.maximum(size, 1e-300), 1.0)) @ np.linalg.inv(v)).real


def norm_budget(blocks: list[np.ndarray]) -> float:
    return float(sum(np.linalg.norm(b, 2) for b in blocks))


def forecast_gain(blocks: list[np.ndarray], horizon: int) -> float:
    """The largest norm, over leads, of the map from the stacked state to the forecast."""
    a, k = companion(blocks), len(blocks[0])
    power, best = np.eye(len(a)), 0.0
    for _ in range(horizon):
        power = a @ power
        best = max(best, float(np.linalg.norm(power[:k], 2)))
    return best


def _blended(blocks: list[np.ndarray], b: float) -> list[np.ndarray]:
    k = len(blocks[0])
    return [blocks[0] * b + np.eye(k) * (1 - b), *[x * b for x in blocks[1:]]]


def limit_gain(blocks: list[np.ndarray], horizon: int, cap: float = GAIN_CAP) -> tuple[list[np.ndarray], float]:
    """The largest blend with persistence, by bisection, whose gain is within the cap."""
    if forecast_gain(blocks, horizon) <= cap:
        return blocks, 1.0
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if forecast_gain(_blended(blocks, mid), horizon) <= cap else (lo, mid)
    return _blended(blocks, lo), lo


def limit_radius(blocks: list[np.ndarray], most: float = 1.0) -> list[np.ndarray]:
    """All blocks times one factor, the largest by bisection that keeps the spectral radius within `most`.

    One factor for all lags keeps the memory's shape, the weight of each lag against the others.
    """
    if spectral_radius(companion(blocks)) <= most:
        return blocks
    lo, hi = 0.0, 1.0
    while hi - lo >= 1e-12:
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if spectral_radius(companion([x * mid for x in blocks])) > most else (mid, hi)
    return [x * lo for x in blocks]


def blend_with_persistence(blocks: list[np.ndarray], tail: np.ndarray, horizon: int, cap: float = GAIN_CAP) -> tuple[list[np.ndarray], float]:
    """The blend on a 21-point grid with the least squared error on a hold-out tail (T x k), among those within the gain cap.

    With fewer than four origins in the tail the cap is 1.
    """
    lags, best = len(blocks), (np.inf, 0.0)
    origins = range(lags - 1, len(tail) - horizon)
    cap = cap if len(origins) >= 4 else 1.0
    for b in BLENDS:
        trial = _blended(blocks, b)
        if b and forecast_gain(trial, horizon) > cap:
            continue
        a, k = companion(trial), tail.shape[1]
        err = 0.0
        for t in origins:
            z = np.concatenate([tail[t - j] for j in range(lags)])
            for h in range(1, horizon + 1):
                z = a @ z
                err += ((z[:k] - tail[t + h]) ** 2).sum()
        best = min(best, (err, b))
    return _blended(blocks, best[1]), best[1]


def horizon_fit(zz: np.ndarray, zy: np.ndarray, target: np.ndarray, mu: float, nu: float, penalty: np.ndarray | None = None) -> np.ndarray:
    """The map shrunk to a target: (YZ' + nu T)(ZZ' + mu I + nu P)^-1; nu infinite is the target itself."""
    if math.isinf(nu):
        return target
    p = np.eye(len(zz)) if penalty is None else penalty
    return np.linalg.solve(zz + mu * np.eye(len(zz)) + nu * p, zy + nu * (target @ p).T).T


def horizon_family(weights: DataFrame, lags: int, horizon: int, mu: float = 1e-3, grid: tuple[float, ...] = (0.0, 1.0, 10.0, 100.0, 1e3, math.inf), holdout: float = 0.2) -> pd.DataFrame:
    """horizons.horizon_rows for few fields, as a pandas table: field, lead, nu, error on the held out rows, defect, map."""
    from fieldcast.operators import horizons

    rows = horizons.horizon_rows(horizons.horizon_design(weights, lags, horizon), lags, horizon, criterion="holdout", mu=mu, grid=grid, holdout=holdout)
    return rows.orderBy("field", "lead").toPandas().rename(columns={"score": "error"})[["field", "lead", "nu", "error", "defect", "map"]]


def memory_sweep(weights: DataFrame, most: int, mu: float = 1e-3) -> DataFrame:
    """(field, order, rho, gain, last_ratio, n_parameters, rmse) for memory depths 1 .. most, all from the windows of the deepest: one
    row of moments a field has every depth's sums in its first rows and columns. weights: (field, t, observed, w)."""
    kind = dict(weights.dtypes)["field"]
    rows = delay_line(weights, most).select("field", F.concat("x", "y").alias("z"), F.size("y").alias("k"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                k, m = int(r.k), np.asarray(r.xx).reshape(len(r.sx), -1)
                for order in range(1, most + 1):
                    zz, zy, yy = m[: order * k, : order * k], m[: order * k, most * k :], m[most * k :, most * k :]
                    theta = ridge(zz, zy, mu).T
                    blocks = [theta[:, j * k : (j + 1) * k] for j in range(order)]
                    s, cross = np.linalg.svd(blocks[-1], compute_uv=False), theta @ zy
                    rest = np.trace(yy - cross - cross.T + theta @ zz @ theta.T)
                    out.append((r.field, order, spectral_radius(companion(blocks)), forecast_gain(blocks, 6), float(s[-1] / max(s[0], 1e-300)), theta.size, float(np.sqrt(max(rest, 0.0) / (r.n * k)))))
            yield pd.DataFrame(out, columns=["field", "order", "rho", "gain", "last_ratio", "n_parameters", "rmse"])

    return moments(rows, ["field", "k"], "z").mapInPandas(task, f"field {kind}, order int, rho double, gain double, last_ratio double, n_parameters int, rmse double")


def emission_rows(rows: DataFrame, mu: float = 1e-3, holdout: float = 0.15, full: bool = True) -> DataFrame:
    """(field, k, c, s, r2, r2_fit, correlation, usable, n): a field's model y = C w of weather from states, matrices row by row.

    rows: (field, t, w, y). r2 is that of the last `holdout` of a field's rows, by channel, with C from those before; C and the
    noise covariance s (its diagonal unless full) then come from all, r2_fit too. usable: any channel has a positive r2.
    """
    kind = dict(rows.dtypes)["field"]
    held = F.round(F.col("n") * holdout) if holdout > 0 else F.lit(0)
    cut = numbered(rows.select("field", "t", F.concat("w", "y").alias("z"), F.size("w").alias("k"))).withColumn("part", (F.col("nth") > F.col("n") - held).cast("int"))
    schema = f"field {kind}, k int, c array<double>, s array<double>, r2 array<double>, r2_fit array<double>, correlation array<double>, usable boolean, n long"

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        k, size = int(f["k"].iloc[0]), len(f["sx"].iloc[0])
        zero = (0, np.zeros((size, size)), np.zeros(size))
        part = {int(r.part): (int(r.n), np.asarray(r.xx).reshape(size, size), np.asarray(r.sx)) for r in f.itertuples()}
        fit, val = part.get(0, zero), part.get(1, zero)
        every = tuple(a + b for a, b in zip(fit, val, strict=True))
        solved = lambda m: ridge(m[1][:k, :k], m[1][:k, k:], mu).T

        def rest(c: np.ndarray, m: tuple) -> np.ndarray:
            cross = c @ m[1][:k, k:]
            return symmetric(m[1][k:, k:] - cross - cross.T + c @ m[1][:k, :k] @ c.T)

        def r2(c: np.ndarray, m: tuple) -> np.ndarray:
            total = np.diag(m[1])[k:] - m[2][k:] ** 2 / max(m[0], 1)
            return 1 - np.diag(rest(c, m)) / np.maximum(total, 1e-30)

        outside = r2(solved(fit), val) if val[0] else None
        c = solved(every)
        cov = rest(c, every) / max(every[0] - 1, 1)
        cov = cov if full else np.diag(np.diag(cov))
        cov = cov + 1e-8 * max(np.trace(cov) / len(cov), 1e-12) * np.eye(len(cov))
        d = np.sqrt(np.maximum(np.diag(cov), 1e-30))
        usable = outside is None or bool((outside > 0).any())
        return pd.DataFrame([(f["field"].iloc[0], k, c.ravel(), cov.ravel(), outside, r2(c, every), (cov / np.outer(d, d)).ravel(), usable, every[0])], columns=[x.split()[0] for x in schema.split(", ")])

    return moments(cut.select("field", "part", "k", "z"), ["field", "part", "k"], "z").groupBy("field").applyInPandas(solve, schema)


def emission_fit(rows: DataFrame, mu: float = 1e-3, holdout: float = 0.15) -> dict:
    """emission_rows of few fields as {field: C, R, r2, usable}."""
    of = lambda r, x: np.asarray(x).reshape(-1, r.k)
    return {r.field: {"C": of(r, r.c), "R": np.asarray(r.s).reshape(len(r.r2_fit), -1), "r2": r.r2, "usable": r.usable} for r in emission_rows(rows, mu, holdout).collect()}


def information_gain(emissions: DataFrame, covs: DataFrame) -> DataFrame:
    """covs (field, .., cov: k x k row by row) with trace_prior, trace_posterior and removed, the share of the state's variance that
    one weather update takes away."""
    names, kinds = covs.columns, covs.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds) + ", trace_prior double, trace_posterior double, removed double"

    def one(f: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(e):
            return pd.DataFrame(columns=[*names, "trace_prior", "trace_posterior", "removed"])
        k = int(e["k"].iloc[0])
        c = np.asarray(e["c"].iloc[0]).reshape(-1, k)
        s = np.asarray(e["s"].iloc[0]).reshape(len(c), -1)
        p = np.stack(f["cov"].to_numpy()).reshape(-1, k, k)
        cp = c @ p
        less = np.einsum("nij,nij->n", np.linalg.solve(cp @ c.T + s, cp), cp)
        prior = np.trace(p, axis1=1, axis2=2)
        return f.assign(trace_prior=prior, trace_posterior=prior - less, removed=less / np.maximum(prior, 1e-30))

    return covs.groupBy("field").cogroup(emissions.groupBy("field")).applyInPandas(one, schema)


def response_maps(models: DataFrame, basis: DataFrame) -> DataFrame:
    """(field, pixel, channel, response): what a unit of each input does to each pixel in a day, phi . B[:, channel]."""
    width = F.size("b") / F.col("k")
    own = models.where(F.size("b") > 0).select("field", F.transform(F.sequence(F.lit(0), (width - 1).cast("int")), lambda j: F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.get("b", (i * width + j).cast("int")))).alias("columns"))
    each = own.select("field", F.posexplode("columns").alias("channel", "column"))
    return basis.select("field", "pixel", "phi").join(each, "field").select("field", "pixel", "channel", dot(F.col("phi"), F.col("column")).alias("response"))


def excitation(design: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(field, rank, required, deficiency, satisfied, condition) of the states and inputs together: fewer independent directions
    than columns, and their parts in a fit cannot be told apart. design: (field, x, u)."""
    kind = dict(design.dtypes)["field"]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                s = np.sqrt(np.maximum(np.linalg.eigvalsh(np.asarray(r.xx).reshape(len(r.sx), -1)), 0))
                rank = int((s > max(tolerance, 1e-8) * s.max()).sum())
                out.append((r.field, rank, len(s), len(s) - rank, rank >= len(s), float(s.max() / max(s.min(), 1e-30))))
            yield pd.DataFrame(out, columns=["field", "rank", "required", "deficiency", "satisfied", "condition"])

    return moments(design.select("field", F.concat("x", "u").alias("z")), ["field"], "z").mapInPandas(task, f"field {kind}, rank int, required int, deficiency int, satisfied boolean, condition double")
