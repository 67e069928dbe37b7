"""The moment accumulator: sums of products of array columns by key, from which all ridge fits are solved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts in which the sums of all tasks meet, and then these, before they meet in one.
MEET, AGAIN = 64, 8


def moments(rows: DataFrame, keys: list[str], x: str = "x", y: str | None = None) -> DataFrame:
    """(keys, n, xx, xy, yy, sx): n, sum x x', sum x y' (row by row), sum y^2 by component, and sum x.

    Each task sums its own rows by key with matrix products, so only one row for each task and key is shuffled. These meet
    in three steps, by key and one of MEET parts, then of AGAIN, so that no group has more than a few matrices. Rows of a key must have
    vectors of one length.
    """
    cols = [*keys, x, *([y] if y else [])]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", n long, xx array<double>, xy array<double>, yy array<double>, sx array<double>"

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for f in frames:
            groups = f.groupby(keys, dropna=False, sort=False) if keys else [((), f)]
            for key, g in groups:
                key = key if isinstance(key, tuple) else (key,)
                a = np.stack(g[x].to_numpy()).astype(float)
                b = np.stack(g[y].to_numpy()).astype(float) if y else np.zeros((len(a), 0))
                part = [len(a), a.T @ a, a.T @ b, (b * b).sum(0), a.sum(0)]
                held[key] = [u + v for u, v in zip(held[key], part, strict=True)] if key in held else part
        yield pd.DataFrame([[*k, v[0], *[m.ravel() for m in v[1:]]] for k, v in held.items()], columns=[*keys, "n", "xx", "xy", "yy", "sx"])

    parts = rows.select(*cols).mapInPandas(task, schema).withColumn("_meet", F.spark_partition_id())

    def total(f: pd.DataFrame, final: bool) -> pd.DataFrame:
        out = f.iloc[:1].copy()
        out["n"] = f["n"].sum()
        for c in ("xx", "xy", "yy", "sx"):
            first, *rest = f[c]
            own = np.array(first, float)
            for v in rest:
                own += v
            out[c] = [own]
        return out[[c.split()[0].strip("`") for c in (schema if final else f"{schema}, _meet int").split(", ")]]

    meet = lambda f: total(f, False)
    for many in (MEET, AGAIN):
        parts = parts.groupBy(*keys, F.pmod("_meet", F.lit(many)).alias("_part")).applyInPandas(meet, f"{schema}, _meet int")
    return parts.groupBy(*keys).applyInPandas(lambda f: total(f, True), schema)


def gram_cells(rows: DataFrame, keys: list[str], x: str, r: int) -> DataFrame:
    """(keys, i, j, value) of sum x x' by column expressions alone, for short vectors."""
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col(x)[i] * F.col(x)[j]).alias(f"m_{i}_{j}") for i in range(r) for j in range(r)])
    return sums.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m_{i}_{j}").alias("value")) for i in range(r) for j in range(r)])).alias("c")).select(*keys, "c.*")


def cells(table: DataFrame, keys: list[str], column: str, width: int) -> DataFrame:
    """A matrix column in long form (keys, i, j, value)."""
    long = table.select(*keys, F.posexplode(column).alias("p", "value"))
    return long.select(*keys, F.floor(F.col("p") / width).cast("int").alias("i"), (F.col("p") % width).cast("int").alias("j"), "value")
