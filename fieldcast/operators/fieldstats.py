"""Statistics of each pixel over time, their digests by split and season, and season coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldcast.functions.dates import season_days, season_end, season_label, season_of, season_start, season_year


def field_stats(pixels: DataFrame, keys: list[str], min_observations: int = 3, min_level: float = 1e-6) -> DataFrame:
    """keys, n, mean, variance (ddof 1), median, iqr, cv and cv_robust of each group of valid values.

    Groups of fewer values than min_observations are null; cv is null where the mean is nearer to 0 than min_level,
    cv_robust where the median is.
    """
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = pixels.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"), q.alias("q"))
    ok = lambda c: F.when(F.col("n") >= min_observations, c)
    med, iqr = F.col("q")[1], F.col("q")[2] - F.col("q")[0]
    return s.select(
        *keys, "n", ok(F.col("m")).alias("mean"), ok(F.col("v")).alias("variance"), ok(med).alias("median"), ok(iqr).alias("iqr"),
        ok(F.when(F.abs("m") >= min_level, F.sqrt("v") / F.col("m"))).alias("cv"), ok(F.when(F.abs(med) >= min_level, iqr / F.abs(med))).alias("cv_robust"),
    )


def stats_digest(stats: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_pixels, mean of means, mean standard deviation, median cv, and the share of pixels without statistics."""
    return stats.groupBy(*keys).agg(
        F.count("*").alias("n_pixels"), F.avg("mean").alias("mean_of_mean"), F.avg(F.sqrt("variance")).alias("mean_sd"),
        F.percentile("cv", 0.5).alias("median_cv"), F.avg(F.col("mean").isNull().cast("int")).alias("masked"),
    )


def with_season(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"season": season_of(F.col("date")), "start_year": season_year(F.col("date"))})


def season_report(pixels: DataFrame, splits: DataFrame, min_frames: int = 20) -> DataFrame:
    """(field, split, season, n_frames, digest): seasons with fewer frames than min_frames are left out."""
    rows = with_season(pixels.join(splits.select("field", "date", "split"), ["field", "date"]))
    keys = ["field", "split", "season"]
    frames = rows.select(*keys, "date").distinct().groupBy(*keys).agg(F.count("*").alias("n_frames")).where(F.col("n_frames") >= min_frames)
    digest = stats_digest(field_stats(rows.join(frames, keys, "left_semi"), [*keys, "pixel"]), keys)
    return frames.join(digest, keys)


def season_instances(dates: DataFrame) -> DataFrame:
    """(field, season, start_year, start, end, nominal_days, label) of the instances that the dates touch."""
    s, y = F.col("season"), F.col("start_year")
    own = with_season(dates).select("field", "season", "start_year").distinct()
    return own.select("field", "season", "start_year", season_start(s, y).alias("start"), season_end(s, y).alias("end"), season_days(s, y).alias("nominal_days"), season_label(s, y).alias("label"))


def overlap_days(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.datediff(F.least(a1, b1), F.greatest(a0, b0)) + 1)


def season_coverage(cal: DataFrame) -> DataFrame:
    """(split, season, coverage): how many instances of a season each split covers, in whole seasons; season null is the total."""
    windows = cal.groupBy("field", "split").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    pairs = season_instances(cal).join(windows, "field")
    share = overlap_days(F.col("start"), F.col("end"), F.col("first"), F.col("last")) / F.col("nominal_days")
    return pairs.withColumn("share", share).rollup("field", "split", "season").agg(F.sum("share").alias("coverage")).where("field is not null and split is not null")


def coverage_check(coverage: DataFrame, targets: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """targets (split, season, target) with coverage and whether it is within the tolerance."""
    got = coverage.select("split", "season", "coverage")
    return targets.join(got, ["split", "season"], "left").withColumn("ok", F.coalesce(F.abs(F.col("coverage") - F.col("target")) <= tolerance, F.lit(False)))
