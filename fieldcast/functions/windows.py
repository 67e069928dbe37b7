"""Windows over long series, cut into blocks of days: a field of many days is many window partitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Days of a block.
BLOCK = 1024


def over_days(rows: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], before: int, after: int, keys: tuple[str, ...] = ("field",), t: str = "t", block: int = BLOCK) -> DataFrame:
    """rows with columns(window), where the window is that of the keys in the order of t, and a row's columns look at most
    `before` days back and `after` days ahead.

    t counts days, one row for each. Every block gets copies of the neighbouring blocks' days that its own rows look at;
    these copies go again afterwards. So the answers are those of one window for each key. Null keys and days go.
    """
    at = F.floor(F.col(t) / block)
    near = F.sequence(F.floor((F.col(t) - after) / block), F.floor((F.col(t) + before) / block))
    wide = rows.withColumns({"_own": at, "_block": F.explode(near)})
    w = Window.partitionBy(*keys, "_block").orderBy(t)
    return wide.withColumns(columns(w)).where("_own = _block").drop("_own", "_block")


def numbered(rows: DataFrame, keys: tuple[str, ...] = ("field",), t: str = "t", block: int = BLOCK) -> DataFrame:
    """rows with nth (from 1) in the order of t for each key, and n, its number of rows: by blocks and the blocks' counts."""
    at = rows.withColumn("_block", F.floor(F.col(t) / block))
    w = Window.partitionBy(*keys).orderBy("_block")
    counts = at.groupBy(*keys, "_block").agg(F.count("*").alias("_here"))
    sums = counts.select(*keys, "_block", (F.sum("_here").over(w) - F.col("_here")).alias("_before"), F.sum("_here").over(Window.partitionBy(*keys)).alias("n"))
    own = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(t))
    return at.withColumn("_own", own).join(sums, [*keys, "_block"]).withColumn("nth", F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")
