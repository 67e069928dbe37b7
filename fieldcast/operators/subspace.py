"""Subspaces of the states as rows: projection of states and covariances, lifts of operators, and bands of decoded forecasts.

A subspace is a row (field, r, k, mean, axes), axes k by r row by row. Rows of a field meet it in parts of days, pixels in
blocks, so that one field is many tasks and a subspace goes once to each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.operators.moments import moments

#: Days of a part, and pixels of a block.
PART, BLOCK = 2048, 4096


def subspace_rows(weights: DataFrame, energy: float = 0.995, least: int = 4, most: int | None = None) -> DataFrame:
    """(field, r, k, mean, axes, shares) from the rows of weights (field, w), the training rows: the fewest leading axes of the centred
    states that reach the energy, at least `least` and at most `most`; shares of all axes."""
    kind = dict(weights.dtypes)["field"]

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f.itertuples():
                mean = np.asarray(x.sx) / x.n
                values, vectors = np.linalg.eigh(np.asarray(x.xx).reshape(len(mean), -1) / x.n - np.outer(mean, mean))
                values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
                shares = values / max(values.sum(), 1e-300)
                k = min(max(int(np.searchsorted(np.cumsum(shares), energy - 1e-12)) + 1, least), most or len(mean), len(mean))
                out.append((x.field, len(mean), k, mean, vectors[:, :k].T.ravel(), shares))
            yield pd.DataFrame(out, columns=["field", "r", "k", "mean", "axes", "shares"])

    return moments(weights, ["field"], "w").mapInPandas(task, f"field {kind}, r int, k int, mean array<double>, axes array<double>, shares array<double>")


def _axes(row) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes)."""
    return np.asarray(row.mean), np.asarray(row.axes).reshape(int(row.k), int(row.r))


def _met(rows: DataFrame, sub: DataFrame, part, one: Callable, schema: str) -> DataFrame:
    """one(rows of a part, the field's row of sub) for each part of each field."""
    names = [c.split()[0].strip("`") for c in schema.split(", ")]
    dealt = rows.withColumn("_part", part)
    each = sub.join(rows.select("field", part.alias("_at")).distinct(), "field")

    def both(f: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return one(f, next(s.itertuples(index=False)))[names] if len(f) and len(s) else pd.DataFrame(columns=names)

    return dealt.groupBy("field", "_part").cogroup(each.groupBy("field", "_at")).applyInPandas(both, schema)


def _schema(df: DataFrame, drop: tuple[str, ...] = (), **more: str) -> str:
    own = [(c, t) for c, t in df.dtypes if c not in drop and c not in more]
    return ", ".join(f"`{c}` {t}" for c, t in [*own, *more.items()])


def projected(weights: DataFrame, sub: DataFrame, cov: str | None = None) -> DataFrame:
    """weights (field, t, w, ..) with z, the coordinates, complement, what these leave out, and, where cov names the states' covariances,
    cov_z = U'SU. Fields without a subspace go."""
    kinds = {"z": "array<double>", "complement": "array<double>"} | ({"cov_z": "array<double>"} if cov else {})

    def one(f: pd.DataFrame, s) -> pd.DataFrame:
        mean, u = _axes(s)
        w = np.stack(f["w"].to_numpy()) - mean
        z = w @ u.T
        f = f.assign(z=list(z), complement=list(w - z @ u))
        if cov:
            f["cov_z"] = list((u @ np.stack(f[cov].to_numpy()).reshape(len(f), int(s.r), -1) @ u.T).reshape(len(f), -1))
        return f

    return _met(weights, sub, F.floor(F.col("t") / PART), one, _schema(weights, **kinds))


def reconstructed(rows: DataFrame, sub: DataFrame, complement: str | None = None) -> DataFrame:
    """rows (field, z, ..) with w = mean + Uz, and what `complement` names added: the part of an origin's state that no model moves.
    Rows have a column t (any number that deals them out)."""

    def one(f: pd.DataFrame, s) -> pd.DataFrame:
        mean, u = _axes(s)
        w = np.stack(f["z"].to_numpy()) @ u + mean
        return f.assign(w=list(w + np.stack(f[complement].to_numpy()) if complement else w))

    return _met(rows, sub, F.floor(F.col("t") / PART), one, _schema(rows, w="array<double>"))


def decoded_drift(rows: DataFrame, basis: DataFrame) -> DataFrame:
    """One row (truncation, static_complement): over all pixels and days of rows (field, t, w), the root mean square of phi . w and of its
    change from a field's row to the next. Sums over the pixels are w' G w, G the sum of phi phi', so that no row is decoded."""
    ahead = Window.partitionBy("field").orderBy("t")
    steps = rows.select("field", "t", "w", F.lag("w").over(ahead).alias("was"))
    gram = moments(basis.where("phi is not null"), ["field"], "phi").select("field", F.col("n").alias("many"), "xx")

    def one(f: pd.DataFrame, g) -> pd.DataFrame:
        w = np.stack(f["w"].to_numpy())
        m = np.asarray(g.xx).reshape(w.shape[1], -1)
        later = f["was"].notna().to_numpy()
        d = w[later] - np.stack(f["was"][later].to_numpy()) if later.any() else w[:0]
        square = lambda x: float(np.einsum("ti,ij,tj->", x, m, x))
        return pd.DataFrame([(square(d), len(d) * g.many, square(w), len(w) * g.many)], columns=["step", "n_step", "part", "n_part"])

    sums = _met(steps, gram, F.floor(F.col("t") / PART), one, "step double, n_step long, part double, n_part long")
    root = lambda x: F.sqrt(F.greatest(F.try_divide(F.sum(x), F.sum(f"n_{x}")), F.lit(0.0)))
    return sums.agg(F.when(F.sum("n_step") > 0, root("step")).alias("truncation"), F.when(F.sum("n_part") > 0, root("part")).alias("static_complement"))


def lifted_models(models: DataFrame, sub: DataFrame) -> DataFrame:
    """Model rows of the subspace as rows of the whole states: U A U', UB, U Q U'. Nonzero eigenvalues stay as they are."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for x in f.itertuples():
                u, k, r = np.asarray(x.axes).reshape(int(x.k), int(x.r_)), int(x.k), int(x.r_)
                a = [(u.T @ b @ u).ravel() for b in np.asarray(x.a).reshape(int(x.lags), k, k)]
                out.append((x.field, r, int(x.lags), np.concatenate(a), (u.T @ np.asarray(x.b).reshape(k, -1)).ravel(), (u.T @ np.asarray(x.q).reshape(k, k) @ u).ravel()))
            yield pd.DataFrame(out, columns=["field", "k", "lags", "a", "b", "q"])

    both = models.select("field", "k", "lags", "a", "b", "q").join(sub.select("field", F.col("r").alias("r_"), "axes"), "field")
    return both.mapInPandas(task, f"field {dict(models.dtypes)['field']}, k int, lags int, a array<double>, b array<double>, q array<double>")


def lifted_covariances(rows: DataFrame, sub: DataFrame, cov: str = "cov") -> DataFrame:
    """rows (field, t, cov: k by k, ..) with cov as U S U', r by r: of rank k, since nothing is claimed of what was never modelled."""

    def one(f: pd.DataFrame, s) -> pd.DataFrame:
        _, u = _axes(s)
        return f.assign(**{cov: list((u.T @ np.stack(f[cov].to_numpy()).reshape(len(f), int(s.k), -1) @ u).reshape(len(f), -1))})

    return _met(rows, sub, F.floor(F.col("t") / PART), one, _schema(rows))


def bands(basis: DataFrame, forecasts: DataFrame, keys: list[str], noise: float, sub: DataFrame | None = None, cov: str | None = "cov") -> DataFrame:
    """(field, keys, pixel, variance) of decoded forecasts, in the units of the states' fields: phi'S phi + noise.

    forecasts: (field, keys, cov), S k by k, in the subspace if one is given; with cov None (field, keys, cov_trace) and S is taken as
    trace / k times the identity, right in its whole and in where the basis is thin. Pixels of a block go once into the
    subspace; a covariance then meets them as a factor, so that a pixel costs no more than its coordinates.
    """
    kinds = dict(forecasts.dtypes)
    value = cov or "cov_trace"
    pixel = dict(basis.dtypes)["pixel"]
    names = ["field", *keys, "pixel", "variance"]
    schema = ", ".join([f"field {kinds['field']}", *[f"`{k}` {kinds[k]}" for k in keys], f"pixel {pixel}", "variance double"])
    size = basis.groupBy("field").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).alias("many"))
    own = basis.select("field", "pixel", "phi").join(size, "field").withColumn("block", F.pmod(F.xxhash64("pixel"), F.col("many"))).drop("many")
    each = forecasts.select("field", *keys, value).join(size, "field").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).drop("many")
    if sub is not None:
        own = own.join(sub.select("field", "r", "k", "axes").join(size, "field").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))).drop("many"), ["field", "block"])

    def one(p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(f):
            return pd.DataFrame(columns=names)
        psi = np.stack(p["phi"].to_numpy())
        if "axes" in p:
            psi = psi @ np.asarray(p["axes"].iloc[0]).reshape(int(p["k"].iloc[0]), int(p["r"].iloc[0])).T
        k, power, out = psi.shape[1], (psi * psi).sum(1), []
        for row in f.itertuples(index=False):
            s = getattr(row, value)
            if cov is None:
                var = max(s, 0.0) / k * power
            else:
                d, v = np.linalg.eigh(np.asarray(s).reshape(k, k))
                var = ((psi @ (v * np.sqrt(np.maximum(d, 0)))) ** 2).sum(1)
            out.append(pd.DataFrame({"field": p["field"].iloc[0], **{x: getattr(row, x) for x in keys}, "pixel": p["pixel"].to_numpy(), "variance": var + noise})[names])
        return pd.concat(out, ignore_index=True)

    return own.groupBy("field", "block").cogroup(each.groupBy("field", "block")).applyInPandas(one, schema)
