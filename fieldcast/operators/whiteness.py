"""Tests for structure left in residual vectors e (field, t, e: array of doubles)."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldcast.functions.linalg import chi2_sf
from fieldcast.functions.vectors import minus
from fieldcast.functions.windows import numbered, over_days
from fieldcast.sources.stages import stored


def differences(weights: DataFrame, value: str = "w") -> DataFrame:
    """(field, t, e): one-step differences; the first row of a field has none."""
    rows = over_days(numbered(weights.select("field", "t", value)), lambda w: {"before": F.lag(value).over(w)}, 1, 0, t="nth")
    return rows.select("field", "t", F.when(F.col("before").isNotNull(), minus(F.col(value), F.col("before"))).alias("e")).where("e is not null")


def autocorrelation(e: DataFrame, max_lag: int) -> DataFrame:
    """(field, i, k, rho, n) of each component, about its mean."""
    long = numbered(e.select("field", "t", "e")).select("field", F.col("nth").alias("t"), F.posexplode("e").alias("i", "x"))
    mean = long.groupBy("field", "i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.count("x").alias("n"))
    z = long.join(mean, ["field", "i"]).select("field", "i", "t", (F.col("x") - F.col("m")).alias("z"), "v", "n")
    products = lambda w: {f"p{k}": F.col("z") * F.lag("z", k).over(w) for k in range(1, max_lag + 1)}
    lagged = over_days(z, products, max_lag, 0, ("field", "i"))
    sums = lagged.groupBy("field", "i").agg(F.first("v").alias("v"), F.first("n").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, max_lag + 1)])
    return sums.select("field", "i", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.try_divide(F.col(f"p{k}"), F.col("n") * F.col("v")).alias("rho")) for k in range(1, max_lag + 1)])).alias("x"), "v").select("field", "i", "x.k", "x.rho", "n")


def residual_autocorrelation(rho: DataFrame) -> DataFrame:
    """(field, k, mean_abs, band): mean of absolute autocorrelations and the 95 % band of white noise."""
    return rho.groupBy("field", "k").agg(F.avg(F.abs("rho")).alias("mean_abs"), (1.96 / F.sqrt(F.max("n"))).alias("band"))


def ljung_box(rho: DataFrame, max_lag: int) -> DataFrame:
    """(field, i, statistic, p) of each component."""
    q = rho.groupBy("field", "i").agg((F.max("n") * (F.max("n") + 2) * F.sum(F.col("rho") * F.col("rho") / (F.col("n") - F.col("k")))).alias("statistic"))
    tail = F.pandas_udf(lambda s: s.map(lambda x: chi2_sf(float(x), max_lag)), DoubleType())
    return q.withColumn("p", tail("statistic"))


def benjamini_hochberg(tests: DataFrame, keys: list[str], p: Column, alpha: float = 0.05) -> DataFrame:
    """tests with reject: step-up control of the false discovery rate inside each group of keys.

    Ranks are running counts of the distinct p of a group, which lie in ranges by key and p: a range is counted in its own
    task, after the counts of the ranges before it, so that a large group is many tasks.
    """
    each = tests.withColumn("_p", p)
    counts = each.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    ranges = stored(counts.repartitionByRange(*keys, "_p").withColumn("_range", F.spark_partition_id()), "ranges")
    behind = Window.partitionBy(*keys).orderBy("_range")
    sums = ranges.groupBy(*keys, "_range").agg(F.sum("_n").alias("_sum"))
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_at"), (F.sum("_sum").over(behind.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("_m"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_range") == F.col("_at")]
    run = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_p"))
    ranked = ranges.join(sums, reduce(and_, same)).withColumn("_rank", run + F.col("_before"))
    last = ranked.groupBy(*keys).agg(F.max(F.when(F.col("_p") <= alpha * F.col("_rank") / F.col("_m"), F.col("_p"))).alias("_last"))
    last = last.select(*[F.col(k).alias(f"_{k}") for k in keys], "_last")
    got = each.join(F.broadcast(last), reduce(and_, same[:-1]), "left") if keys else each.crossJoin(F.broadcast(last))
    return got.select(*tests.columns, F.coalesce(F.col("_p") <= F.col("_last"), F.lit(False)).alias("reject"))


def portmanteau(e: DataFrame, lags: int = 10, seed: int = 0) -> DataFrame:
    """(field, d, lags, statistic, dof, p): Hosking's test on a random projection to d with d * d * lags <= T / 4.

    The vectors of a field, a row a day, are taken together.
    """

    def one(f):
        import pandas as pd

        x = np.array(f.sort_values("t")["e"].tolist())
        n, r = x.shape
        d = max(1, min(r, int(np.sqrt(n / (4 * lags)))))
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((r, d)))[0]
        z = (x - x.mean(0)) @ q
        inv = np.linalg.inv(z.T @ z / n + 1e-12 * np.eye(d))
        stat = 0.0
        for k in range(1, lags + 1):
            c = z[k:].T @ z[:-k] / n
            stat += np.trace(c.T @ inv @ c @ inv) / (n - k)
        stat *= n * n
        return pd.DataFrame({"field": [f["field"].iloc[0]], "d": [d], "lags": [lags], "statistic": [stat], "dof": [d * d * lags], "p": [chi2_sf(stat, d * d * lags)]})

    kind = dict(e.dtypes)["field"]
    return e.groupBy("field").applyInPandas(one, f"field {kind}, d int, lags int, statistic double, dof int, p double")


def whiteness_verdict(lb: DataFrame, hosking: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(field, n_rejected, portmanteau_p, white): no component rejected after the step-up, nor the portmanteau."""
    n = benjamini_hochberg(lb, ["field"], F.col("p"), alpha).groupBy("field").agg(F.count_if("reject").alias("n_rejected"))
    return n.join(hosking.select("field", F.col("p").alias("portmanteau_p")), "field").withColumn("white", (F.col("n_rejected") == 0) & (F.col("portmanteau_p") >= alpha))
