"""Basis features, states of frames by ridge regression on a basis, and their decoding.

basis: (field, pixel, phi array<double>, offset double); weights: (field, date, w array<double>, ..).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions.linalg import ridge
from fieldcast.functions.vectors import dot
from fieldcast.operators.moments import moments

#: Variance of a state that no frame informs. Fixed value.
NO_INFORMATION = 1e6


def rbf_features(x: Column, y: Column, centres: list[tuple[float, float]], length: float) -> Column:
    """exp(-d^2 / 2 l^2) against each centre."""
    square = lambda cx, cy: (x - cx) * (x - cx) + (y - cy) * (y - cy)
    return F.array(*[F.exp(square(cx, cy) * (-0.5 / length**2)) for cx, cy in centres])


def fourier_features(x: Column, y: Column, n: int, scale: float = 1.0, seed: int = 0) -> Column:
    """sin and cos of 2 pi x B for n seeded random directions B."""
    b = np.random.default_rng(seed).standard_normal((n, 2)) * scale * 2 * np.pi
    angle = [x * float(u) + y * float(v) for u, v in b]
    return F.array(*[F.sin(a) for a in angle], *[F.cos(a) for a in angle])


def user_features(grid: DataFrame, features: Callable[[np.ndarray], np.ndarray], columns: tuple[str, str] = ("x", "y")) -> DataFrame:
    """grid with phi from a user's function of an (n, 2) array of coordinates, a batch at a time."""

    @F.pandas_udf("array<double>")
    def phi(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(features(np.stack([a, b], 1)), float)))

    return grid.withColumn("phi", phi(*columns))


def shaded(basis: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(field, n, n_dead, share, smallest): basis columns whose largest absolute value is within the tolerance."""
    each = basis.select("field", F.posexplode("phi").alias("j", "v")).groupBy("field", "j").agg(F.max(F.abs("v")).alias("top"))
    dead = F.count_if(F.col("top") <= tolerance)
    return each.groupBy("field").agg(F.count("*").alias("n"), dead.alias("n_dead"), (dead / F.count("*")).alias("share"), F.min("top").alias("smallest"))


#: Up to so many components the products of phi are summed as columns, beyond as matrices in tasks.
SHORT = 16


def cross_moments(rows: DataFrame, keys: list[str], x: str, y: str, r: int | None = None) -> DataFrame:
    """(keys, n, xy, yy, sy): sum x y, sum y^2 and sum y for a scalar y. A task sums its rows by key first; x of a given length r up
    to SHORT is summed as columns."""
    if r is not None and r <= SHORT:
        v = F.col(y)
        sums = F.array(*[F.sum(F.col(x)[i] * v) for i in range(r)])
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), sums.alias("xy"), F.sum(v * v).alias("yy"), F.sum(v).alias("sy"))
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, xy array<double>, yy double, sy double"

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            for key, g in f.groupby(keys, dropna=False, sort=False):
                v = g[y].to_numpy(float)
                part = [len(g), v @ np.stack(g[x].to_numpy()), v @ v, v.sum()]
                held[key] = [a + b for a, b in zip(held[key], part, strict=True)] if key in held else part
        yield pd.DataFrame([[*k, *v] for k, v in held.items()], columns=[*keys, "n", "xy", "yy", "sy"])

    parts = rows.select(*keys, x, y).mapInPandas(task, schema)
    # Sums by component stay in the JVM.
    long = parts.select(*keys, "n", "yy", "sy", F.posexplode("xy").alias("i", "v"))
    head = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("yy").alias("yy"), F.sum("sy").alias("sy"))
    sums = long.groupBy(*keys, "i").agg(F.sum("v").alias("v")).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("xy"))
    return head.join(sums, keys)


def solve_states(pixels: DataFrame, basis: DataFrame, noise: float, cov: bool = False, r: int | None = None) -> DataFrame:
    """(field, date, w, n_valid, r2[, cov]) of every date that has a frame; w = (F'F + noise I)^-1 F'(y - offset).

    Fewer than two valid pixels give zeros, with the covariance of no information. r is the length of phi, read from the
    basis unless given. Short vectors take one aggregation by date, whatever the masks; long ones share a Gram matrix
    between the dates of a mask.
    """
    if r is None:
        first = basis.select(F.size("phi").alias("r")).first()
        r = first.r if first else 1
    return _by_date(pixels, basis, noise, cov, r) if r <= SHORT else _by_mask(pixels, basis, noise, cov)


def _by_date(pixels: DataFrame, basis: DataFrame, noise: float, cov: bool, r: int) -> DataFrame:
    got = pixels.where("value is not null").join(basis.select("field", "pixel", "phi", "offset"), ["field", "pixel"])
    phi, y = [F.col("phi")[i] for i in range(r)], F.col("value") - F.coalesce("offset", F.lit(0.0))
    upper = [(i, j) for i in range(r) for j in range(i, r)]
    sums = [F.sum(phi[i] * phi[j]) for i, j in upper] + [F.sum(p * y) for p in phi] + [F.sum(y * y), F.sum(y)]
    rows = got.groupBy("field", "date").agg(F.count("*").alias("n_valid"), F.array(*sums).alias("sums"))
    kind = dict(pixels.dtypes)["field"]
    schema = f"field {kind}, date date, w array<double>, n_valid long, r2 double" + (", cov array<double>" if cov else "")
    at = np.array(upper).T

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s, n = np.stack(f["sums"].to_numpy()), f["n_valid"].to_numpy()
            m = np.empty((len(f), r, r))
            m[:, at[0], at[1]] = m[:, at[1], at[0]] = s[:, : len(upper)]
            b, yy, sy = s[:, len(upper) : len(upper) + r], s[:, -2], s[:, -1]
            inv = np.linalg.inv(m + noise * np.eye(r))
            w = np.einsum("tij,tj->ti", inv, b)
            few = n < 2
            w[few] = 0
            left = yy - 2 * (w * b).sum(1) + np.einsum("ti,tij,tj->t", w, m, w)
            out = f[["field", "date", "n_valid"]].assign(w=list(w), r2=1 - left / (yy - sy**2 / n + 1e-12))
            if cov:
                out["cov"] = [(NO_INFORMATION * np.eye(r) if x else noise * v).ravel() for x, v in zip(few, inv, strict=True)]
            yield out[["field", "date", "w", "n_valid", "r2", *(["cov"] if cov else [])]]

    return rows.mapInPandas(solve, schema)


def _by_mask(pixels: DataFrame, basis: DataFrame, noise: float, cov: bool) -> DataFrame:
    """States by one Gram matrix for each distinct mask, which a sum of hashes of its pixels stands for."""
    valid = pixels.where("value is not null").select("field", "date", "pixel", "value")
    mask = valid.groupBy("field", "date").agg(F.sum(F.shiftright(F.xxhash64("pixel"), 20)).alias("mask"), F.count("*").alias("n_valid"))
    got = valid.join(basis, ["field", "pixel"]).withColumn("y", F.col("value") - F.coalesce("offset", F.lit(0.0)))
    rhs = cross_moments(got, ["field", "date"], "phi", "y").join(mask, ["field", "date"])
    one = mask.groupBy("field", "mask").agg(F.min("date").alias("date"))
    gram = moments(got.join(one, ["field", "date"]), ["field", "mask"], "phi").select("field", "mask", F.col("xx").alias("gram"))
    kind = dict(pixels.dtypes)["field"]
    schema = f"field {kind}, date date, w array<double>, n_valid long, r2 double" + (", cov array<double>" if cov else "")

    def solve(g: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(f) or not len(g):
            return pd.DataFrame(columns=["field", "date", "w", "n_valid", "r2", *(["cov"] if cov else [])])
        m = np.asarray(g["gram"].iloc[0])
        r = int(np.sqrt(len(m)))
        m = m.reshape(r, r)
        inv = np.linalg.inv(m + noise * np.eye(r))
        b = np.stack(f["xy"].to_numpy())
        w = b @ inv
        few = f["n_valid"].to_numpy() < 2
        w[few] = 0
        res = f["yy"].to_numpy() - 2 * (w * b).sum(1) + np.einsum("ti,ij,tj->t", w, m, w)
        total = f["yy"].to_numpy() - f["sy"].to_numpy() ** 2 / f["n"].to_numpy()
        out = {"field": f["field"], "date": f["date"], "w": list(w), "n_valid": f["n_valid"], "r2": 1 - res / (total + 1e-12)}
        if cov:
            out["cov"] = [(NO_INFORMATION * np.eye(r) if x else noise * inv).ravel() for x in few]
        return pd.DataFrame(out)

    return gram.groupBy("field", "mask").cogroup(rhs.groupBy("field", "mask")).applyInPandas(solve, schema)


def on_calendar(states: DataFrame, cal: DataFrame, r: int, cov: bool = False) -> DataFrame:
    """A row for each day: days without a frame have zeros and, with cov, the covariance of no information."""
    got = cal.join(states, ["field", "date"], "left")
    zeros = F.array_repeat(F.lit(0.0), r)
    out = got.withColumns({"w": F.coalesce("w", zeros), "n_valid": F.coalesce("n_valid", F.lit(0))})
    wide = F.transform(F.sequence(F.lit(0), F.lit(r * r - 1)), lambda i: F.when(i % (r + 1) == 0, NO_INFORMATION).otherwise(0.0))
    return out.withColumn("cov", F.coalesce("cov", wide)) if cov else out


#: Parts that the rows of a field are dealt into where they meet all its pixels, so that one field is not one task.
DEALT = 32


def _met(basis: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with each pixel of its field: rows are dealt out by their keys, the pixels go to each part.

    The copies of the pixels come from a join, since Spark counts those in its estimate: it takes exploded ones for as small as the
    table they are made from, and a small file of many pixels would go whole through the driver, DEALT times.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(*keys) if keys else F.lit(0), F.lit(DEALT)))
    parts = basis.sparkSession.range(DEALT).select(F.col("id").alias("part"))
    return basis.crossJoin(F.broadcast(parts)).join(dealt.withColumn("part", F.col("part").cast("long")), ["field", "part"]).drop("part")


def _product(w: str, r: int | None) -> Column:
    """phi . w + offset. Vectors of a given length r up to SHORT are multiplied as columns."""
    product = dot(F.col("phi"), F.col(w))
    if r is not None and 0 < r <= SHORT:
        product = F.col("phi")[0] * F.col(w)[0]
        for i in range(1, r):
            product = product + F.col("phi")[i] * F.col(w)[i]
    return product + F.coalesce("offset", F.lit(0.0))


def decode(weights: DataFrame, basis: DataFrame, keys: list[str], r: int | None = None) -> DataFrame:
    """(field, keys, pixel, pred): phi . w + offset for each row of weights (field, keys, w). Vectors of a given length r up to SHORT
    are multiplied as columns."""
    rows = _met(basis.select("field", "pixel", "phi", "offset"), weights.select("field", *keys, "w"), keys)
    return rows.select("field", *keys, "pixel", _product("w", r).alias("pred"))


def forecast_errors(forecasts: DataFrame, basis: DataFrame, truth: DataFrame, keys: list[str], r: int | None = None, noise: float | None = None) -> DataFrame:
    """(field, keys, origin, lead, target, pixel, pred, value, error[, variance]), further columns of basis: what scoring.with_truth
    makes of decode(), with noise also the variance of subspace.bands.

    forecasts: (field, keys, origin, lead, w[, cov]), days as dates. Only pixels with a value on the target day are decoded: values
    take their basis vector and then meet the few forecasts of their field and day, so that no decoded row is shuffled.
    """
    more = [c for c in basis.columns if c not in ("field", "pixel", "phi", "offset")]
    seen = truth.where("value is not null").select("field", F.col("date").alias("target"), "pixel", "value")
    seen = seen.join(basis.select("field", "pixel", "phi", "offset", *more), ["field", "pixel"])
    own = forecasts.select("field", *keys, "origin", "lead", F.expr("date_add(origin, lead)").alias("target"), "w", *(["cov"] if noise is not None else []))
    own = own if noise is None else _factored(own)
    got = seen.join(own, ["field", "target"]).withColumn("pred", _product("w", r)).where("pred is not null")
    names = ["field", *keys, "origin", "lead", "target", "pixel", "pred", "value", (F.col("pred") - F.col("value")).alias("error"), *more]
    if noise is not None:
        length = F.aggregate("factor", F.lit(0.0), lambda s, axis: s + dot(F.col("phi"), axis) * dot(F.col("phi"), axis))
        if r is not None and 0 < r <= SHORT:
            along = [sum((F.col("phi")[i] * F.col("factor")[k][i] for i in range(1, r)), F.col("phi")[0] * F.col("factor")[k][0]) for k in range(r)]
            length = sum((a * a for a in along[1:]), along[0] * along[0])
        names.append((length + noise).alias("variance"))
    return got.select(*names)


def _factored(rows: DataFrame) -> DataFrame:
    """rows with factor in the place of cov: vectors whose squared products with phi sum to phi' S phi, what is below zero in S left out."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "cov") + ", factor array<array<double>>"

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            s = np.stack(f["cov"].to_numpy())
            k = math.isqrt(s.shape[1])
            d, v = np.linalg.eigh(s.reshape(-1, k, k))
            axes = (v * np.sqrt(np.maximum(d, 0))[:, None, :]).transpose(0, 2, 1)
            yield f.drop(columns="cov").assign(factor=[list(x) for x in axes])

    return rows.mapInPandas(task, schema)


def decoded_variance(basis: DataFrame, covs: DataFrame, keys: list[str], noise: float) -> DataFrame:
    """(field, keys, pixel, variance): phi' S phi + noise for each row of covs (field, keys, cov)."""
    both = _met(basis.select("field", "pixel", "phi"), covs.select("field", *keys, "cov"), keys)
    kinds = dict(both.dtypes)
    schema = f"field {kinds['field']}, pixel {kinds['pixel']}" + "".join(f", `{k}` {kinds[k]}" for k in keys) + ", variance double"

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = np.stack(f["phi"].to_numpy())
            s = np.stack(f["cov"].to_numpy()).reshape(len(f), p.shape[1], -1)
            yield f.assign(variance=np.einsum("ni,nij,nj->n", p, s, p) + noise)[["field", "pixel", *keys, "variance"]]

    return both.mapInPandas(task, schema)


def uncertainty_band(trace: Column, r: int, phi: Column, noise: float, scale: Column | float, repvar: Column) -> Column:
    """sqrt of (trace / r |phi|^2 + noise) scale^2 + the representation variance."""
    from fieldcast.functions.vectors import norm2

    return F.sqrt(F.greatest((trace / r * norm2(phi) + noise) * scale * scale + repvar, F.lit(0.0)))


def log_marginal(n: int, gram: np.ndarray, xy: np.ndarray, yy: float, noise: float, prior: float = 1.0) -> float:
    """Log marginal likelihood of y = F w + e from moments, w of variance prior and e of variance noise."""
    r = len(gram)
    a = gram / noise + np.eye(r) / prior
    _, logdet = np.linalg.slogdet(a)
    m = np.linalg.solve(a, xy / noise)
    return float(-0.5 * (n * np.log(2 * np.pi * noise) + r * np.log(prior) + logdet + yy / noise - xy @ m / noise))


def residuals(pixels: DataFrame, states: DataFrame, basis: DataFrame) -> DataFrame:
    """(field, date, pixel, value, residual) of the valid cells on the states' dates."""
    got = pixels.where("value is not null").join(basis, ["field", "pixel"]).join(states.select("field", "date", "w"), ["field", "date"])
    return got.select("field", "date", "pixel", "value", (F.col("value") - F.coalesce("offset", F.lit(0.0)) - dot(F.col("phi"), F.col("w"))).alias("residual"))


def climatology_offset(pixels: DataFrame, train: DataFrame, basis: DataFrame) -> DataFrame:
    """basis with the pixel's training mean as its offset."""
    mean = pixels.join(train.select("field", "date"), ["field", "date"]).groupBy("field", "pixel").agg(F.avg("value").alias("offset"))
    return basis.drop("offset").join(mean, ["field", "pixel"], "left").withColumn("offset", F.coalesce("offset", F.lit(0.0)))


def residual_modes(resid: DataFrame, field, q: int) -> tuple[DataFrame, list[float]]:
    """((field, pixel, modes), energies): the q leading empirical modes of the residuals of one field.

    The T x T matrix of products over pixels is summed by tasks from blocks of pixels, its eigenvectors are found on
    the driver (T is a few thousand days), and each pixel's modes are its residuals times these.
    """
    own = resid.where(F.col("field") == field)
    dates = [r.date for r in own.select("date").distinct().orderBy("date").collect()]
    at = F.create_map(*[x for i, d in enumerate(dates) for x in (F.lit(d), F.lit(i))])
    wide = own.groupBy("field", "pixel").agg(F.map_from_entries(F.collect_list(F.struct(at[F.col("date")].alias("i"), F.col("residual").alias("v")))).alias("m"))
    rows = wide.select("field", "pixel", F.transform(F.sequence(F.lit(0), F.lit(len(dates) - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))).alias("x"))
    g = moments(rows, ["field"], "x").select("xx").first().xx
    gram = np.asarray(g).reshape(len(dates), len(dates))
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    order = np.argsort(values)[::-1][:q]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    good = values > 1e-15 * max(values[0], 1e-300) if len(values) else np.zeros(0, bool)
    u = [(vectors[:, k] / np.sqrt(values[k])).tolist() for k in np.flatnonzero(good)]
    modes = rows.select("field", "pixel", F.array(*[dot(F.col("x"), F.array(*map(F.lit, v))) for v in u]).alias("modes"))
    return modes, values[good].tolist()


def augmented(basis: DataFrame, modes: DataFrame) -> DataFrame:
    """basis with the modes, scaled to the basis's mean column norm, put behind phi."""
    norms = basis.select("field", F.posexplode("phi").alias("j", "v")).groupBy("field", "j").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n")).groupBy("field").agg(F.avg("n").alias("k"))
    got = basis.join(modes, ["field", "pixel"], "left").join(norms, "field")
    return got.withColumn("phi", F.concat("phi", F.transform("modes", lambda m: m * F.col("k")))).drop("modes", "k")


def fit_subspace(weights: DataFrame, energy: float = 0.995, least: int = 4, most: int | None = None) -> dict:
    """{field: (mean, basis r x k, explained shares)} from the rows of weights (field, w), which are the training rows."""
    out = {}
    for r in moments(weights, ["field"], "w").collect():  # r x r numbers a field
        n, mean = r.n, np.asarray(r.sx) / r.n
        c = np.asarray(r.xx).reshape(len(mean), -1) / n - np.outer(mean, mean)
        values, vectors = np.linalg.eigh((c + c.T) / 2)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        k = min(max(int(np.searchsorted(share, energy - 1e-12)) + 1, least), most or len(mean), len(mean))
        out[r.field] = (mean, vectors[:, :k], values / max(values.sum(), 1e-300))
    return out


def project(weights: DataFrame, model: dict, column: str = "w") -> DataFrame:
    """weights with z, the coordinates in the field's subspace, and complement, what these leave out and a decoder adds back."""
    kinds = dict(weights.dtypes)
    rows = [(f, m.tolist(), b.T.tolist()) for f, (m, b, _) in model.items()]
    small = weights.sparkSession.createDataFrame(rows, f"field {kinds['field']}, mean array<double>, axes array<array<double>>")
    got = weights.join(small, "field").withColumn("centred", F.zip_with(column, "mean", lambda a, b: a - b))
    got = got.withColumn("z", F.transform("axes", lambda a: dot(a, F.col("centred"))))
    back = F.aggregate(F.zip_with("z", "axes", lambda z, a: F.transform(a, lambda v: v * z)), F.transform("mean", lambda v: v), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return got.withColumn("complement", F.zip_with(F.col(column), back, lambda a, b: a - b)).drop("mean", "axes", "centred")


def rank_report(weights: DataFrame) -> pd.DataFrame:
    """A row for each field: ranks at 95 % and 99 % of the energy, numerical rank, and whether r is over four times the rank at 99 %."""
    rows = []
    for r in moments(weights, ["field"], "w").collect():
        mean = np.asarray(r.sx) / r.n
        c = np.asarray(r.xx).reshape(len(mean), -1) / r.n - np.outer(mean, mean)
        values = np.sort(np.maximum(np.linalg.eigvalsh((c + c.T) / 2), 0))[::-1]
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        r99 = int(np.searchsorted(share, 0.99 - 1e-12)) + 1
        rows.append((r.field, len(mean), int(np.searchsorted(share, 0.95 - 1e-12)) + 1, r99, int((values > 1e-15 * max(values[0], 1e-300)).sum()), len(mean) > 4 * r99))
    return pd.DataFrame(rows, columns=["field", "r", "rank95", "rank99", "numerical", "over"])


def emission(rows: DataFrame, mu: float = 1e-3) -> dict:
    """{field: C} of y = C w by ridge, from rows (field, w, y: arrays)."""
    out = {}
    for r in moments(rows, ["field"], "w", "y").collect():
        k = len(r.sx)
        out[r.field] = ridge(np.asarray(r.xx).reshape(k, k), np.asarray(r.xy).reshape(k, -1), mu).T
    return out
