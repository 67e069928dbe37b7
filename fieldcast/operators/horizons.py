"""Horizon families: for each field and lead a map of the state, between the direct one and the iterated memory model.

All leads of a field come from one row of moments of [x | u | y]: stacked lags, inputs of the days ahead, and targets of
all leads. One eigendecomposition for a field and lead serves every weight nu of the shrinkage, for the fit as for its
score, and no model reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.functions.linalg import companion, ridge, symmetric
from fieldcast.functions.windows import numbered, over_days
from fieldcast.operators.dynamics import unpacked
from fieldcast.operators.moments import moments

#: The weights that are tried, from the direct map to the iterated one.
GRID = (0.0, 1e-2, 1e-1, 1.0, 1e1, 1e2, 1e3, 1e4, 1e5, math.inf)
CRITERIA = ("gcv", "holdout", "likelihood")


def horizon_design(weights: DataFrame, lags: int, horizon: int, forcing: str | None = None) -> DataFrame:
    """(field, t, x, u, y): x stacks w at t .. t - lags + 1, u the inputs at t .. t + horizon - 1, y stacks w at t + 1 .. t + horizon.

    weights: (field, t, observed, w) and the forcing column, a row a day. Only rows whose whole window is in the calendar
    and observed; so all leads have the same rows.
    """

    def columns(w):
        span = w.rowsBetween(-(lags - 1), horizon)
        many = lambda c, steps: F.flatten(F.array(*[F.col(c) if not j else F.lead(c, j).over(w) if j > 0 else F.lag(c, -j).over(w) for j in steps]))
        u = many(forcing, range(horizon)) if forcing else F.array().cast("array<double>")
        ok = (F.min(F.col("observed").cast("int")).over(span) == 1) & (F.count("*").over(span) == lags + horizon)
        return {"x": many("w", range(0, -lags, -1)), "u": u, "y": many("w", range(1, horizon + 1)), "ok": ok}

    return over_days(weights, columns, lags - 1, horizon).where("ok").select("field", "t", "x", "u", "y")


def iterated(blocks: list[np.ndarray], b: np.ndarray, horizon: int, q: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(map of the stacked state, maps of the inputs side by side, covariance by passing q on) for each lead of a memory model."""
    a, k = companion(blocks), len(blocks[0])
    power, cov, steps = np.eye(len(a)), None if q is None else np.zeros((k, k)), []
    for _ in range(horizon):
        first = power[:k, :k]
        steps.insert(0, first @ b)
        if q is not None:
            cov = cov + first @ q @ first.T
        power = power @ a
        yield power[:k], np.hstack(steps), cov


class Path:
    """The shrunk maps (y z' + nu T P)(z z' + mu I + nu P)^-1 for every nu, from one decomposition.

    P is 1 on the state's components, and on the inputs' too if these are shrunk. With W from the decomposition of P
    against z z' + mu I the inverse is W (I + nu D)^-1 W', and so is all that a score needs.
    """

    def __init__(self, zz: np.ndarray, zy: np.ndarray, target: np.ndarray, mu: float, shrunk: np.ndarray):
        self.zz, self.zy, self.target, self.mu, self.shrunk = zz, zy, target, mu, shrunk
        low = np.linalg.inv(np.linalg.cholesky(zz + mu * np.eye(len(zz))))
        d, v = np.linalg.eigh(low @ (shrunk[:, None] * low.T))
        self.d, self.w = np.maximum(d, 0), low.T @ v
        self.fit, self.pull = zy.T @ self.w, (target * shrunk) @ self.w
        self.spread = np.einsum("ij,ij->j", self.w, zz @ self.w)

    def map(self, nu: float) -> np.ndarray:
        if math.isfinite(nu):
            return ((self.fit + nu * self.pull) / (1 + nu * self.d)) @ self.w.T
        out, free = self.target.copy(), ~self.shrunk.astype(bool)
        if free.any():  # inputs alone are fitted, to what the target leaves
            left = self.zy[free].T - out[:, ~free] @ self.zz[np.ix_(~free, free)]
            out[:, free] = ridge(self.zz[np.ix_(free, free)], left.T, self.mu).T
        return out

    def freedom(self, nu: float) -> float:
        """Effective degrees of freedom of the fit."""
        return float((self.spread / (1 + nu * self.d)).sum()) if math.isfinite(nu) else float((self.shrunk == 0).sum())


def left_over(g: np.ndarray, zz: np.ndarray, zy: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Sum of squares and products of the residuals y - g z."""
    cross = g @ zy
    return symmetric(yy - cross - cross.T + g @ zz @ g.T)


def score(path: Path, nu: float, criterion: str, n: int, yy: np.ndarray, held: tuple) -> float:
    """Lower is better. gcv: of the rows of the path, n of them with products yy. The others: of the held out rows (n, zz, zy, yy),
    the mean square or the Gaussian likelihood of the residuals under their own covariance."""
    g = path.map(nu)
    if criterion == "gcv":
        return n * float(np.trace(left_over(g, path.zz, path.zy, yy))) / max(n - path.freedom(nu), 1e-6) ** 2
    m, zz, zy, hh = held
    rest = left_over(g, zz, zy, hh)
    if criterion == "holdout":
        return float(np.trace(rest)) / max(m * len(rest), 1)
    cov = rest / max(m - 1, 1)
    cov = cov + 1e-8 * np.trace(cov) / len(cov) * np.eye(len(cov))
    sign, logdet = np.linalg.slogdet(cov)
    return 0.5 * (float(np.trace(np.linalg.solve(cov, rest))) / max(m, 1) + logdet) if sign > 0 else math.inf


def horizon_rows(
    design: DataFrame, lags: int, horizon: int, models: DataFrame | None = None, estimator: str = "shrunk", criterion: str = "gcv", mu: float = 1e-3, grid: tuple[float, ...] = GRID,
    holdout: float = 0.15, shrink_inputs: bool = False,
) -> DataFrame:
    """(field, lead, map, inputs, sigma, target, nu, score, n, defect, relative, normalised, trace_direct, trace_iterated, trace_bias,
    trace_nominal): a map for each field and lead, matrices row by row.

    design: of horizon_design(). models: rows of dynamics.fit_table; without, a field's iterated model is the one-step fit
    of these very rows. estimator: direct (nu 0), iterated (nu infinite) or shrunk, with nu by `criterion`: gcv, holdout or
    likelihood, the last two on the last `holdout` of a field's rows; the map is then fitted on all rows.

    sigma is the covariance of the lead's own residuals. defect: norm of map less target, the iterated one, also over the
    target's norm, and as its effect on forecasts against their spread. The traces are of sigma, of the iterated map's real
    errors, of what the bias adds to sigma by theory, and of the model's noise passed on.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"criterion {criterion!r} is none of {', '.join(CRITERIA)}")
    if estimator not in ("direct", "iterated", "shrunk"):
        raise ValueError(f"estimator {estimator!r} is none of direct, iterated, shrunk")
    kind = dict(design.dtypes)["field"]
    held = F.greatest(F.lit(1), F.round(F.col("n") * holdout))
    parts = numbered(design).withColumn("part", (F.col("nth") > F.col("n") - held).cast("int"))
    sums = moments(parts.select("field", "part", F.concat("x", "u", "y").alias("z"), F.size("x").alias("p"), F.size("u").alias("e")), ["field", "part", "p", "e"], "z")

    def solve(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return pd.DataFrame(columns=names)
        size, p, e = len(f["sx"].iloc[0]), int(f["p"].iloc[0]), int(f["e"].iloc[0])
        k, ell = p // lags, e // horizon
        zero = (0, np.zeros((size, size)), np.zeros(size))
        both = {int(r.part): (int(r.n), np.asarray(r.xx).reshape(size, size), np.asarray(r.sx)) for r in f.itertuples()}
        fit, val = both.get(0, zero), both.get(1, zero)
        n, xx, sx = fit[0] + val[0], fit[1] + val[1], fit[2] + val[2]
        targets = lambda h: slice(p + e + (h - 1) * k, p + e + h * k)
        inside = lambda h: np.r_[0 : p + h * ell]
        cut = lambda m, h: (m[np.ix_(inside(h), inside(h))], m[inside(h), targets(h)], m[targets(h), targets(h)])
        if len(m):
            blocks, b, q = unpacked(next(m.itertuples()))
        else:
            zz, zy, yy = cut(xx, 1)
            g = ridge(zz, zy, mu).T
            blocks, b, q = [g[:, j * k : (j + 1) * k] for j in range(lags)], g[:, p:], left_over(g, zz, zy, yy) / max(n - 1, 1)
        b = b if b.shape[1] == ell else np.zeros((k, ell))
        centred = (xx[:p, :p] - np.outer(sx[:p], sx[:p]) / max(n, 1)) / max(n - 1, 1)
        out = []
        for h, (theta, inputs, nominal) in enumerate(iterated(blocks, b, horizon, q), 1):
            target = np.hstack([theta, inputs])
            shrunk = np.r_[np.ones(p), np.full(h * ell, float(shrink_inputs))]
            zz, zy, yy = cut(xx, h)
            nu, best = {"direct": 0.0, "iterated": math.inf}.get(estimator, 0.0), math.nan
            if estimator == "shrunk":
                # Inputs are pulled to 0 in no case: their part of the target counts where they are shrunk to it.
                fz, fy, ff = cut(fit[1], h)
                path = Path(fz, fy, target * np.r_[np.ones(p), np.full(h * ell, float(shrink_inputs))], mu, shrunk)
                best, nu = min((score(path, x, criterion, fit[0], ff, (val[0], *cut(val[1], h))), x) for x in grid)
            whole = target if estimator == "iterated" else Path(zz, zy, target * shrunk, mu, shrunk).map(nu)
            spread = np.trace(yy) / max(n, 1) - (sx[targets(h)] ** 2).sum() / max(n, 1) ** 2
            d = whole[:, :p] - theta
            sigma = left_over(whole, zz, zy, yy) / max(n - 1, 1)
            bias = float(np.trace(d @ centred @ d.T))
            real = float(np.trace(left_over(target, zz, zy, yy))) / max(n - 1, 1)
            out.append((
                f["field"].iloc[0], h, whole[:, :p].ravel(), whole[:, p:].ravel(), sigma.ravel(), theta.ravel(), nu, best, n,
                float(np.linalg.norm(d)), float(np.linalg.norm(d) / max(np.linalg.norm(theta), 1e-30)), math.sqrt(max(bias, 0.0) / max(spread, 1e-30)),
                float(np.trace(sigma)), real, bias, float(np.trace(nominal)),
            ))
        return pd.DataFrame(out, columns=names)

    numbers = ("nu", "score"), ("defect", "relative", "normalised", "trace_direct", "trace_iterated", "trace_bias", "trace_nominal")
    schema = f"field {kind}, lead int, map array<double>, inputs array<double>, sigma array<double>, target array<double>, " + ", ".join(f"{c} double" for c in numbers[0]) + ", n long, " + ", ".join(f"{c} double" for c in numbers[1])
    names = [c.split()[0] for c in schema.split(", ")]
    if models is None:
        models = design.sparkSession.createDataFrame([], f"field {kind}, k int, lags int, a array<double>, b array<double>, q array<double>")
    return sums.groupBy("field").cogroup(models.groupBy("field")).applyInPandas(solve, schema)


def coverage(family: DataFrame) -> DataFrame:
    """(field, lead, under, identity, propagated): by how much the errors of the iterated maps exceed the direct covariance, what the
    identity real = direct + bias leaves, and the errors over the covariance that the model's own noise would give."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1e-30))
    return family.select(
        "field", "lead", ratio("trace_iterated", "trace_direct").alias("under"),
        (F.col("trace_iterated") - F.col("trace_direct") - F.col("trace_bias")).alias("identity"), ratio("trace_iterated", "trace_nominal").alias("propagated"),
    )
