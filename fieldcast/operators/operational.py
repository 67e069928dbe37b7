"""Jobs on top of the filter: forecasts for requested days, and the comparison of memory orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.functions.linalg import companion, spectral_radius
from fieldcast.operators import archive, scoring
from fieldcast.operators.dynamics import delay_line, fit_table, forecast_gain, norm_budget, unpacked
from fieldcast.operators.filtering import VARIANTS, rolling_forecasts
from fieldcast.operators.state import decode, forecast_errors, solve_states


def checked_requests(requests: DataFrame, cal: DataFrame, lags: int, horizon: int) -> DataFrame:
    """requests (field, origin) with reason (null: accepted) and scoreable, whether all leads are days of the calendar.

    The calendar is extended to late origins for the reason: these are days without a frame.
    """
    own = cal if "split" in cal.columns else cal.withColumn("split", F.lit("test"))
    got = scoring.validate_origins(requests.distinct(), scoring.extended(own, requests), lags, horizon, allow_train=True)
    last = cal.groupBy("field").agg(F.max("date").alias("last"))
    inside = F.col("reason").isNull() & F.coalesce(F.date_add("origin", horizon) <= F.col("last"), F.lit(False))
    return got.join(last, "field", "left").select("field", "origin", "reason", inside.alias("scoreable"))


def operational_forecasts(
    requests: DataFrame, pixels: DataFrame, basis: DataFrame, models: DataFrame, noise: float, lags: int, horizon: int, context: int = 30,
    variants: tuple = VARIANTS[:1], assimilate: bool = False, covariances: bool = False,
) -> DataFrame:
    """(field, variant, origin, lead, w, cov_trace[, cov]): forecasts from each requested day, many requests in one run.

    Only the days from context - 1 before an origin (lags at least) to horizon after it are read; the basis and the models
    (rows of fit_table with r and rho) are the stored ones, nothing is fitted. A request is filtered over its own window,
    so that requests are shared out over tasks. Requests that checked_requests refuses give no rows. With assimilate,
    frames after the origin are used for the leads after them, each lead's forecast being noted first.
    """
    cal = archive.calendar(pixels)
    good = checked_requests(requests, cal, lags, horizon).where("reason is null").select("field", "origin")
    back = max(context, lags) - 1
    days = good.withColumn("date", F.explode(F.sequence(F.date_sub("origin", back), F.date_add("origin", horizon))))
    frames = pixels.join(days.select("field", "date").distinct(), ["field", "date"], "left_semi")
    states = solve_states(frames, basis, noise).select("field", "date", "w")
    rows = days.join(cal.select("field", "date"), ["field", "date"], "left_semi").join(states, ["field", "date"], "left")
    # A request is a field of its own here, with day 0 at its origin.
    key = F.concat_ws("|", F.col("field").cast("string"), F.col("origin").cast("string"))
    rows = rows.select(key.alias("field"), F.datediff("date", "origin").cast("long").alias("t"), F.col("w").isNotNull().alias("observed"), "w")
    own = models.join(good, "field").withColumn("field", key).drop("origin")
    got = rolling_forecasts(rows, own, {0}, horizon, variants, assimilate, covariances=covariances).withColumnRenamed("field", "request").where("valid")
    named = good.withColumn("request", key)
    return got.drop("origin", "valid").join(named, "request").select("field", "variant", "origin", "lead", "w", "cov_trace", *(["cov"] if covariances else []))


def requested_maps(forecasts: DataFrame, pixels: DataFrame, basis: DataFrame, noise: float, scale: DataFrame | None = None, repvar: DataFrame | None = None, units: str = "", most: int | None = 20) -> DataFrame:
    """Maps of forecasts (field, variant, origin: date, lead, w, cov): field, variant, origin, lead, pixel, forecast, std, error, tags, as
    sinks.write_maps takes them.

    Of a field's origins `most` evenly spaced ones (None: all). scale (field, mean, std) undoes a normalisation; std is the band
    of the forecast's own covariance and the noise, in the data's units, with the representation variance (field, pixel,
    variance) where it is given. Pixels that are not valid on every frame are nodata; error is against the frame of the
    target day, null without one.
    """
    from fieldcast.operators.subspace import bands
    from fieldcast.sources import sinks

    keys = ["variant", "origin", "lead"]
    days = forecasts.select("field", "origin").distinct()
    if most:
        days = scoring.evenly_spaced(days.withColumnRenamed("origin", "date"), most).withColumnRenamed("date", "origin")
        forecasts = forecasts.join(days.select("field", "origin"), ["field", "origin"], "left_semi")
    if scale is None:
        scale = forecasts.select("field").distinct().withColumns({"mean": F.lit(0.0), "std": F.lit(1.0)})
    own = forecasts.withColumnRenamed("origin", "day")
    pred = decode(own.select("field", "variant", "day", "lead", "w"), basis, ["variant", "day", "lead"]).withColumnRenamed("day", "origin")
    var = bands(basis, forecasts, keys, noise).join(scale.select("field", F.col("std").alias("sd")), "field")
    rep = repvar.select("field", "pixel", F.col("variance").alias("rep")) if repvar is not None else basis.select("field", "pixel", F.lit(0.0).alias("rep"))
    std = var.join(rep, ["field", "pixel"], "left").select("field", *keys, "pixel", F.sqrt(F.col("variance") * F.col("sd") * F.col("sd") + F.coalesce("rep", F.lit(0.0))).alias("band"))
    # The frames of target days alone: the archive itself is not shuffled by pixel and day.
    targets = forecasts.select("field", F.expr("date_add(origin, lead)").alias("date")).distinct()
    maps = sinks.forecast_maps(pred, pixels.join(targets, ["field", "date"], "left_semi"), scale, std, units)
    mask = archive.common_mask(archive.pixel_coverage(pixels, archive.calendar(pixels))).select("field", "pixel", F.lit(True).alias("_inside"))
    inside = maps.join(mask, ["field", "pixel"], "left").withColumns({c: F.when(F.col("_inside"), F.col(c)) for c in ("forecast", "std", "error")})
    return sinks.with_nodata(inside.drop("_inside"))


def model_facts(models: DataFrame, horizon: int, keys: list[str]) -> DataFrame:
    """keys, rho, gain, norm_budget, last_ratio (smallest to largest singular value of the last block), n_parameters."""
    kinds = dict(models.dtypes)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                a, b, _ = unpacked(r)
                s = np.linalg.svd(a[-1], compute_uv=False)
                out.append((*[getattr(r, k) for k in keys], spectral_radius(companion(a)), forecast_gain(a, horizon), norm_budget(a), float(s[-1] / max(s[0], 1e-300)), int(np.size(a) + np.size(b))))
            yield pd.DataFrame(out, columns=[*keys, "rho", "gain", "norm_budget", "last_ratio", "n_parameters"])

    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return models.mapInPandas(task, f"{head}, rho double, gain double, norm_budget double, last_ratio double, n_parameters long")


def shared_origins(weights: DataFrame, most: int, horizon: int) -> DataFrame:
    """(field, t, date) of the test days that every order up to `most` can start from: the last `most` days observed, the
    horizon inside the calendar; the first most - 1 test days of a field, whose history reaches into training, go."""
    w = Window.partitionBy("field").orderBy("t")
    back = w.rowsBetween(-(most - 1), 0)
    run = (F.min(F.col("observed").cast("int")).over(back) == 1) & (F.count("*").over(back) == most)
    days = weights.select("field", "t", "date", "split", run.alias("run"), F.max("t").over(Window.partitionBy("field")).alias("last"))
    nth = F.row_number().over(Window.partitionBy("field", "split").orderBy("t"))
    return days.withColumn("nth", nth).where((F.col("split") == "test") & (F.col("nth") > most - 1) & F.col("run") & (F.col("t") + horizon <= F.col("last"))).select("field", "t", "date")


def order_forecasts(weights: DataFrame, orders: list[int], horizon: int, mu: float, noise: float) -> tuple[DataFrame, DataFrame]:
    """(forecasts with order, models with order): a model of each order from the training rows, forecasts from shared origins.

    weights: (field, t, date, observed, split, w) on the calendar.
    """
    train = weights.where("split = 'train'")
    origins = shared_origins(weights, max(orders), horizon).select("field", F.col("t").alias("origin"), "date")
    rows = weights.select("field", F.col("t").cast("long").alias("t"), "observed", "w")
    forecasts, models = None, None
    for order in orders:
        fit = fit_table(delay_line(train, order), mu=mu).withColumns({"r": F.lit(noise), "rho": F.lit(1.0)})
        got = rolling_forecasts(rows, fit, None, horizon, VARIANTS[:1]).where("valid").join(origins, ["field", "origin"])
        got, fit = (d.withColumn("order", F.lit(order)) for d in (got, fit))
        forecasts, models = (got, fit) if forecasts is None else (forecasts.unionByName(got), models.unionByName(fit))
    return forecasts, models


def latent_scores(forecasts: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lead, latent_rmse over origins and components, where the target day is observed. forecasts: field, origin (t), lead, w."""
    truth = weights.where("observed").select("field", F.col("t").alias("target"), F.col("w").alias("seen"))
    both = forecasts.withColumn("target", F.col("origin") + F.col("lead")).join(truth, ["field", "target"])
    square = F.aggregate(F.zip_with("w", "seen", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return both.groupBy(*keys, "lead").agg(F.sqrt(F.sum(square) / F.sum(F.size("w"))).alias("latent_rmse"))


def ablation_scores(forecasts: DataFrame, basis: DataFrame, pixels: DataFrame, r: int | None = None) -> DataFrame:
    """order, lead and the metrics of the decoded forecasts, pooled over fields, origins and pixels."""
    own = forecasts.select("field", "order", F.col("date").alias("origin"), "lead", "w")
    return scoring.horizon_scores(forecast_errors(own, basis, pixels, ["order"], r), ("order",))
