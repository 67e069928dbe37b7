"""Archives of daily fields: validity, calendar, coverage, masks, training statistics.

Tables: pixels (field, date, pixel, value) long, with null for what is not valid; calendar (field, date, t, observed).
Days without a frame are rows of the calendar only, never rows of pixels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of coverage that the common mask relaxes to, in turn. Fixed values.
MASK_LADDER = (1.0, 0.99, 0.95, 0.9, 0.75, 0.5)
SENTINEL = -9999.0


def in_range(value: Column, nodata: float | None = None, lo: float | None = None, hi: float | None = None) -> Column:
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (value != SENTINEL)
    if nodata is not None:
        ok = ok & (value != nodata)
    if lo is not None:
        ok = ok & value.between(lo, hi)
    return F.coalesce(ok, F.lit(False))


def masked(pixels: DataFrame, nodata: float | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """pixels with null for every value that is missing, a nodata mark or out of its physical range."""
    return pixels.withColumn("value", F.when(in_range(F.col("value"), nodata, lo, hi), F.col("value")))


def out_of_range(pixels: DataFrame, lo: float, hi: float, nodata: float | None = None) -> DataFrame:
    """(field, n_valid, n_out, share) of the values that are valid but for their range."""
    ok = in_range(F.col("value"), nodata)
    out = ok & ~F.col("value").between(lo, hi)
    return pixels.groupBy("field").agg(F.count_if(ok).alias("n_valid"), F.count_if(out).alias("n_out"), F.try_divide(F.count_if(out), F.count_if(ok)).alias("share"))


def frame_counts(pixels: DataFrame, cells: int | Column, min_share: float = 0.0, drop_empty: bool = True) -> DataFrame:
    """(field, date, n_valid, observed): with drop_empty a frame of ceil(min_share * cells) valid cells or fewer is no observation."""
    n = F.count("value")
    least = F.ceil(F.lit(min_share) * cells) if isinstance(cells, Column) else F.lit(math.ceil(min_share * cells))
    return pixels.groupBy("field", "date").agg(n.alias("n_valid")).withColumn("observed", (F.col("n_valid") > least) if drop_empty else F.lit(True))


def calendar(frames: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(field, date, t, observed): every day of each field from start to end (its own first and last frame unless given).

    Days and frames meet in one aggregation: Spark takes the days of a span for one row, and would send those of all fields through
    the driver to join them.
    """
    span = frames.groupBy("field").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    first, last = F.col("lo") if start is None else start, F.col("hi") if end is None else end
    days = span.select("field", F.explode(F.sequence(first, last)).alias("date"), first.alias("first_day"), F.lit(False).alias("seen"))
    seen = F.col("observed") if "observed" in frames.columns else F.lit(True)
    have = frames.where("field is not null").select("field", "date", F.lit(None).cast(dict(days.dtypes)["first_day"]).alias("first_day"), seen.alias("seen"))
    both = days.unionByName(have).groupBy("field", "date").agg(F.max("first_day").alias("first_day"), F.coalesce(F.bool_or("seen"), F.lit(False)).alias("observed"))
    return both.where("first_day is not null").select("field", "date", F.datediff("date", "first_day").alias("t"), "observed")


def frames_outside(frames: DataFrame, cal: DataFrame) -> DataFrame:
    """(field, date) of frames that lie outside the calendar."""
    return frames.select("field", "date").distinct().join(cal, ["field", "date"], "left_anti")


def gap_dates(cal: DataFrame) -> DataFrame:
    return cal.where(~F.col("observed")).select("field", "date")


def runs(cal: DataFrame) -> DataFrame:
    """(field, observed, start, end, length) of each run of equal days."""
    island = F.col("t") - F.row_number().over(Window.partitionBy("field", "observed").orderBy("t"))
    return (
        cal.withColumn("island", island)
        .groupBy("field", "observed", "island")
        .agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("length"))
        .drop("island")
    )


def coverage_report(cal: DataFrame) -> DataFrame:
    """A row for each field: days, observed, missing, share, gap runs, longest gap, longest observed run, warn under half."""
    seen = cal.groupBy("field").agg(F.count("*").alias("days"), F.count_if("observed").alias("n_observed"))
    each = runs(cal).groupBy("field").agg(
        F.count_if(~F.col("observed")).alias("gap_runs"),
        F.coalesce(F.max(F.when(~F.col("observed"), F.col("length"))), F.lit(0)).alias("longest_gap"),
        F.coalesce(F.max(F.when(F.col("observed"), F.col("length"))), F.lit(0)).alias("longest_run"),
    )
    share = F.col("n_observed") / F.col("days")
    return seen.join(each, "field").select("field", "days", "n_observed", (F.col("days") - F.col("n_observed")).alias("missing"), share.alias("share"), "gap_runs", "longest_gap", "longest_run", (share < 0.5).alias("warn"))


def pixel_coverage(pixels: DataFrame, cal: DataFrame) -> DataFrame:
    """(field, pixel, n_valid, coverage): share of the observed dates on which the pixel is valid."""
    seen = cal.where("observed")
    total = seen.groupBy("field").agg(F.count("*").alias("n_dates"))
    n = pixels.join(seen.select("field", "date"), ["field", "date"]).groupBy("field", "pixel").agg(F.count("value").alias("n_valid"))
    return n.join(total, "field").select("field", "pixel", "n_valid", (F.col("n_valid") / F.col("n_dates")).alias("coverage"))


def common_mask(coverage: DataFrame, min_pixels: int = 64, ladder: tuple[float, ...] = MASK_LADDER) -> DataFrame:
    """(field, pixel, level): the pixels valid on all dates; with fewer than min_pixels, the first rung that gives enough; if none does, the strict ones."""
    counts = coverage.groupBy("field").agg(*[F.count_if(F.col("coverage") >= f).alias(f"n{i}") for i, f in enumerate(ladder)])
    level = F.coalesce(*[F.when(F.col(f"n{i}") >= min_pixels, F.lit(f)) for i, f in enumerate(ladder)], F.lit(ladder[0]))
    return coverage.join(counts.select("field", level.alias("level")), "field").where("coverage >= level").select("field", "pixel", "level")


def static_mask(pixels: DataFrame, cal: DataFrame, grid: DataFrame) -> DataFrame:
    """(field, is_static, min_share, max_share): whether all observed dates have one mask. grid has (field, pixel)."""
    seen = cal.where("observed")
    dates, cells = seen.groupBy("field").agg(F.count("*").alias("n_dates")), grid.groupBy("field").agg(F.count("*").alias("n_cells"))
    valid = pixels.where("value is not null").join(seen.select("field", "date"), ["field", "date"])
    by_pixel = valid.groupBy("field", "pixel").agg(F.count("*").alias("n")).join(dates, "field")
    fixed = by_pixel.groupBy("field").agg(F.bool_and(F.col("n") == F.col("n_dates")).alias("is_static"))
    by_date = seen.select("field", "date").join(valid.groupBy("field", "date").agg(F.count("*").alias("n")), ["field", "date"], "left").join(cells, "field")
    share = F.coalesce("n", F.lit(0)) / F.col("n_cells")
    return by_date.groupBy("field").agg(F.min(share).alias("min_share"), F.max(share).alias("max_share")).join(fixed, "field", "left").select("field", F.coalesce("is_static", F.lit(True)).alias("is_static"), "min_share", "max_share")


def split_by_date(cal: DataFrame, cut: str) -> DataFrame:
    return cal.withColumn("split", F.when(F.col("date") < F.lit(cut).cast("date"), "train").otherwise("test"))


def split_by_fraction(cal: DataFrame, fraction: float = 0.85) -> DataFrame:
    """The first round(fraction * n) days train, at least 2 and at most n - 1; halves round to even."""
    n = cal.groupBy("field").agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(2), F.least(F.bround(F.lit(fraction) * F.col("n"), 0).cast("int"), F.col("n") - 1))
    nth = F.row_number().over(Window.partitionBy("field").orderBy("date"))
    return cal.withColumn("nth", nth).join(n, "field").withColumn("split", F.when(F.col("nth") <= k, "train").otherwise("test")).drop("nth", "n")


def train_scale(pixels: DataFrame, cal: DataFrame) -> DataFrame:
    """(field, mean, std) of the valid values on observed training days; population std."""
    train = cal.where("observed and split = 'train'").select("field", "date")
    return pixels.join(train, ["field", "date"]).groupBy("field").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def normalise(pixels: DataFrame, scale: DataFrame) -> DataFrame:
    return pixels.join(scale, "field").withColumn("value", (F.col("value") - F.col("mean")) / (F.col("std") + 1e-6)).drop("mean", "std")


def denormalise(pixels: DataFrame, scale: DataFrame) -> DataFrame:
    return pixels.join(scale, "field").withColumn("value", F.col("value") * F.col("std") + F.col("mean")).drop("mean", "std")


def value_summary(pixels: DataFrame, exact: bool = True) -> DataFrame:
    """(field, min, p0_1, mean, p99_9, max, std). exact buffers the values of a field; else percentile_approx is used."""
    q = F.percentile("value", F.array(F.lit(0.001), F.lit(0.999))) if exact else F.percentile_approx("value", [0.001, 0.999], 100_000)
    out = pixels.groupBy("field").agg(F.min("value").alias("min"), q.alias("q"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))
    return out.select("field", "min", F.col("q")[0].alias("p0_1"), "mean", F.col("q")[1].alias("p99_9"), "max", "std")


def value_range(pixels: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(field, lo, hi) for reports: fixed if given, else the 1st and 99th percentile, widened by a half where flat."""
    if lo is not None:
        return pixels.select("field").distinct().select("field", F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    q = pixels.groupBy("field").agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    flat = F.col("q")[0] == F.col("q")[1]
    return q.select("field", F.when(flat, F.col("q")[0] - 0.5).otherwise(F.col("q")[0]).alias("lo"), F.when(flat, F.col("q")[1] + 0.5).otherwise(F.col("q")[1]).alias("hi"))


def whole_window_observed(cal: DataFrame, back: int, ahead: int = 0) -> DataFrame:
    """cal with window_ok: all days from t - back + 1 to t + ahead are in the calendar and observed."""
    w = Window.partitionBy("field").orderBy("t").rowsBetween(-(back - 1), ahead)
    return cal.withColumn("window_ok", (F.min(F.col("observed").cast("int")).over(w) == 1) & (F.count("*").over(w) == back + ahead))


def purge(cal: DataFrame, order: int) -> DataFrame:
    """cal with usable: the first order - 1 test days are not used as origins."""
    nth = F.row_number().over(Window.partitionBy("field", "split").orderBy("t"))
    return cal.withColumn("usable", (F.col("split") == "test") & (nth > order - 1))


def stride(rows: DataFrame, n: int, before_filter: bool = True, keep: Column | None = None) -> DataFrame:
    """Every n-th row of a field in time. keep filters after the count (before_filter) or before it."""
    nth = F.row_number().over(Window.partitionBy("field").orderBy("t")) - 1
    if keep is not None and not before_filter:
        rows = rows.where(keep)
    out = rows.withColumn("nth", nth).where(F.col("nth") % n == 0).drop("nth")
    return out.where(keep) if keep is not None and before_filter else out
