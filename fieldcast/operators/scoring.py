"""Scores of forecasts: origin and target joins, metrics, references, attribution, picks of origins and methods.

forecasts: (field, variant, origin, lead, pixel, pred); truth: (field, date, pixel, value); dates are dates.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def add_leads(origins: DataFrame, horizon: int) -> DataFrame:
    """origins (.., origin) with lead 1 .. horizon and its target day."""
    return origins.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("target", F.expr("date_add(origin, lead)"))


def observed_targets(leads: DataFrame, cal: DataFrame) -> DataFrame:
    """The leads whose target day is in the calendar and observed."""
    seen = cal.where("observed").select("field", F.col("date").alias("target"))
    return leads.join(seen, ["field", "target"], "left_semi")


def with_truth(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """forecasts with the value at their target and the error; only where there is a value."""
    own = forecasts.withColumn("target", F.expr("date_add(origin, lead)"))
    got = own.join(truth.select("field", F.col("date").alias("target"), "pixel", "value"), ["field", "target", "pixel"])
    return got.where("value is not null and pred is not null").withColumn("error", F.col("pred") - F.col("value"))


def metrics(error: Column, scale: float = 1.0) -> list[Column]:
    """rmse, mae, bias and ubrmse over finite errors; null without any."""
    e = F.when(~F.isnan(error) & (F.abs(error) != float("inf")), error)
    mse, bias = F.avg(e * e), F.avg(e)
    return [
        (F.sqrt(mse) * scale).alias("rmse"), (F.avg(F.abs(e)) * scale).alias("mae"), (bias * scale).alias("bias"),
        (F.sqrt(F.greatest(mse - bias * bias, F.lit(0.0))) * scale).alias("ubrmse"),
    ]


def r_squared(value: Column, error: Column) -> Column:
    return 1 - F.sum(error * error) / (F.var_pop(value) * F.count(value) + 1e-12)


def gaussian_nll(error: Column, variance: Column) -> Column:
    v = F.greatest(variance, F.lit(1e-8))
    return F.avg(0.5 * (F.log(v * 6.283185307179586) + error * error / v))


def centred_correlation(a: Column, b: Column) -> Column:
    """The fallback for structural similarity."""
    return F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b) + 1e-12)


def interval_z(level: float) -> float:
    """How many standard deviations a central interval of this level reaches to each side."""
    return NormalDist().inv_cdf((1 + level) / 2)


def windowed_ssim(frames: DataFrame, keys: list[str], side: int = 7) -> DataFrame:
    """keys, ssim: the mean structural similarity over all whole windows of side x side pixels of each frame.

    frames: keys, row, col, pred, value. The data range is the truth's. Frames smaller than a window, or with missing
    cells, take the centred correlation of what they have. A frame is one group.
    """
    kinds = dict(frames.dtypes)

    def box(x: np.ndarray) -> np.ndarray:
        total = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return (total[side:, side:] - total[:-side, side:] - total[side:, :-side] + total[:-side, :-side]) / side**2

    def one(f: pd.DataFrame) -> pd.DataFrame:
        r, c = f["row"] - f["row"].min(), f["col"] - f["col"].min()
        grid = np.full((2, int(r.max()) + 1, int(c.max()) + 1), np.nan)
        grid[0, r, c], grid[1, r, c] = f["pred"], f["value"]
        if min(grid.shape[1:]) < side or not np.isfinite(grid).all():
            a, b = (v - np.nanmean(v) for v in grid)
            ok = np.isfinite(a * b)
            score = float((a[ok] * b[ok]).sum() / (np.sqrt((a[ok] ** 2).sum() * (b[ok] ** 2).sum()) + 1e-12))
        else:
            a, b = grid
            span = b.max() - b.min() + 1e-8
            c1, c2, n = (0.01 * span) ** 2, (0.03 * span) ** 2, side**2 / (side**2 - 1)
            ma, mb = box(a), box(b)
            va, vb, vab = n * (box(a * a) - ma**2), n * (box(b * b) - mb**2), n * (box(a * b) - ma * mb)
            score = float(((2 * ma * mb + c1) * (2 * vab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())
        return f[keys].iloc[:1].assign(ssim=score)

    return frames.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ssim double")


def sequence_scores(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of each frame, then their mean over the frames of keys."""
    each = errors.groupBy(*keys, "target").agg(*metrics(F.col("error")))
    return each.groupBy(*keys).agg(F.count("*").alias("n_frames"), *[F.avg(m).alias(m) for m in ("rmse", "mae", "bias", "ubrmse")])


def horizon_scores(errors: DataFrame, keys: tuple[str, ...] = ("variant",), scale: float = 1.0) -> DataFrame:
    """keys, lead, metrics pooled over origins and pixels, and the number of origins scored."""
    return errors.groupBy(*keys, "lead").agg(*metrics(F.col("error"), scale), F.countDistinct("field", "origin").alias("n_origins"))


def persistence(pixels: DataFrame, origins: DataFrame, horizon: int) -> DataFrame:
    """Forecasts that keep each pixel's value of the origin day."""
    own = pixels.where("value is not null").join(origins.select("field", F.col("date")), ["field", "date"], "left_semi")
    now = own.select("field", F.col("date").alias("origin"), "pixel", F.col("value").alias("pred"), F.lit("persistence").alias("variant"))
    return now.withColumn("lead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def climatology(pixels: DataFrame, splits: DataFrame, origins: DataFrame, horizon: int) -> DataFrame:
    """Forecasts by each pixel's mean over the training days."""
    train = splits.where("split = 'train'").select("field", "date")
    mean = pixels.join(train, ["field", "date"]).groupBy("field", "pixel").agg(F.avg("value").alias("pred"))
    leads = add_leads(origins.select("field", F.col("date").alias("origin")), horizon).drop("target")
    return mean.join(leads, "field").withColumn("variant", F.lit("climatology"))


def pixel_errors(errors: DataFrame, keys: tuple[str, ...] = ("variant", "lead")) -> DataFrame:
    return errors.groupBy("field", *keys, "pixel").agg(*metrics(F.col("error")), F.count("error").alias("n"))


def extreme_pixels(by_pixel: DataFrame, keys: tuple[str, ...] = ("variant", "lead")) -> DataFrame:
    """(keys, metric, best, worst): pixels of lowest and highest rmse and mae, the lowest pixel among equals."""
    rows = by_pixel.select("field", *keys, "pixel", F.explode(F.create_map(F.lit("rmse"), F.round("rmse", 9), F.lit("mae"), F.round("mae", 9))).alias("metric", "score"))
    return rows.where("score is not null").groupBy("field", *keys, "metric").agg(
        F.min_by("pixel", F.struct("score", "pixel")).alias("best"), F.max_by("pixel", F.struct(F.col("score"), -F.col("pixel"))).alias("worst")
    )


def interval_coverage(errors: DataFrame, sigma: Column, z: float, keys: tuple[str, ...] = ("variant", "lead"), more: Sequence[Column] = ()) -> DataFrame:
    """keys, coverage, half_width and the aggregates in more, from one pass over the errors."""
    return errors.groupBy(*keys).agg(F.avg((F.abs("error") <= sigma * z).cast("int")).alias("coverage"), F.avg(sigma * z).alias("half_width"), *more)


def representation_variance(residuals: DataFrame) -> DataFrame:
    """(field, pixel, variance, bias): mean squared and mean residual (residual) of each pixel's reconstruction."""
    return residuals.groupBy("field", "pixel").agg(F.avg(F.col("residual") * F.col("residual")).alias("variance"), F.avg("residual").alias("bias"))


def representation_summary(by_pixel: DataFrame) -> DataFrame:
    return by_pixel.groupBy("field").agg(F.sqrt(F.avg("variance")).alias("rms"), F.avg("bias").alias("mean_bias"), F.count("*").alias("n_pixels"))


def compare_methods(scores: list[DataFrame], by_lead: int = 1) -> DataFrame:
    """Scores of all methods in one table with the order of their ubrmse at one lead; those without it come last."""
    both = scores[0]
    for s in scores[1:]:
        both = both.unionByName(s)
    first = both.where(F.col("lead") == by_lead).select("variant", F.col("ubrmse").alias("key"))
    rank = first.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("key"), "variant"))).select("variant", "rank")
    return both.join(F.broadcast(rank), "variant", "left").orderBy(F.asc_nulls_last("rank"), "lead")


def bias_attribution(scores: DataFrame, encode_bias: DataFrame) -> DataFrame:
    """(variant, encode_bias, dynamics_bias, drift, binding): lead-1 bias less the encoder's, and the bias's slope over leads.

    encode_bias has one row (encode_bias).
    """
    s = scores.groupBy("variant").agg(F.max(F.when(F.col("lead") == 1, F.col("bias"))).alias("lead1"), F.regr_slope("bias", F.col("lead").cast("double")).alias("drift"))
    got = s.join(F.broadcast(encode_bias)).withColumn("dynamics_bias", F.col("lead1") - F.col("encode_bias"))
    return got.select("variant", "encode_bias", "dynamics_bias", "drift", F.when(F.abs("encode_bias") >= F.abs("dynamics_bias"), "encode").otherwise("dynamics").alias("binding"))


def worst_pixels(errors: DataFrame, pixels: DataFrame, n: int = 5) -> DataFrame:
    """The n pixels of highest lead-1 rmse, with their growth over leads, mean observed move at lead 1, and a verdict.

    event: the pixel itself moved by over half its error; else representation: its error hardly grows with the
    lead; else dynamics.
    """
    by = errors.groupBy("field", "pixel", "lead").agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
    slope = by.groupBy("field", "pixel").agg(F.max(F.when(F.col("lead") == 1, F.col("rmse"))).alias("rmse1"), F.regr_slope("rmse", F.col("lead").cast("double")).alias("slope"))
    order = Window.partitionBy("field").orderBy(F.desc_nulls_last(F.round("rmse1", 9)), "pixel")
    top = slope.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    moves = errors.where("lead = 1").select("field", "pixel", "origin", F.col("value").alias("after"))
    moves = moves.join(pixels.select("field", "pixel", F.col("date").alias("origin"), F.col("value").alias("before")), ["field", "pixel", "origin"])
    move = moves.groupBy("field", "pixel").agg(F.avg(F.abs(F.col("after") - F.col("before"))).alias("move1"))
    verdict = F.when(F.col("move1") > 0.5 * F.col("rmse1"), "event").when(F.abs("slope") < 0.1 * F.col("rmse1"), "representation").otherwise("dynamics")
    return top.join(move, ["field", "pixel"], "left").withColumn("verdict", verdict)


def reconstruction(residuals: DataFrame) -> DataFrame:
    """(field, r2, rmse): median over dates of each date's R squared, and the rmse over all. residuals: date, value, residual."""
    each = residuals.groupBy("field", "date").agg(r_squared(F.col("value"), F.col("residual")).alias("r2"), F.sum(F.col("residual") * F.col("residual")).alias("ss"), F.count("*").alias("n"))
    return each.groupBy("field").agg(F.percentile("r2", 0.5).alias("r2"), F.sqrt(F.sum("ss") / F.sum("n")).alias("rmse"))


def holdout_errors(residuals: DataFrame) -> DataFrame:
    """(field, fit_rmse, holdout_rmse, gap): residuals carry part, fit or holdout."""
    mse = lambda p: F.sqrt(F.avg(F.when(F.col("part") == p, F.col("residual") * F.col("residual"))))
    got = residuals.groupBy("field").agg(mse("fit").alias("fit_rmse"), mse("holdout").alias("holdout_rmse"))
    return got.withColumn("gap", F.col("holdout_rmse") - F.col("fit_rmse"))


def open_loop_bound(rho: Column, encode: Column, step: Column, lead: Column) -> Column:
    """encode * rho^h + step * (1 + rho + .. + rho^(h-1)); the sum is h where rho is 1 within 1e-6."""
    geometric = F.when(F.abs(rho - 1) < 1e-6, lead.cast("double")).otherwise(F.try_divide(F.pow(rho, lead) - 1, rho - 1))
    return encode * F.pow(rho, lead) + step * geometric


def validate_origins(requested: DataFrame, cal: DataFrame, back: int, horizon: int, allow_train: bool = False) -> DataFrame:
    """requested (field, origin) with reason (null: accepted) and scoreable. cal has split.

    An origin past the calendar's last day is none of its days and so not on it; a caller that forecasts from such
    a day extends the calendar first.
    """
    w = Window.partitionBy("field").orderBy("t").rowsBetween(-(back - 1), 0)
    days = cal.withColumns({"run_ok": (F.min(F.col("observed").cast("int")).over(w) == 1) & (F.count("*").over(w) == back), "last": F.max("date").over(Window.partitionBy("field"))})
    got = requested.join(days.select("field", F.col("date").alias("origin"), "observed", "run_ok", "split", "last"), ["field", "origin"], "left")
    reason = (
        F.when(F.col("observed").isNull(), "not on the calendar")
        .when(~F.col("observed"), "not observed")
        .when(~F.col("run_ok"), f"fewer than {back} observed days behind")
        .when((F.col("split") == "train") & F.lit(not allow_train), "in training")
    )
    return got.select("field", "origin", reason.alias("reason"), (reason.isNull() & (F.date_add("origin", horizon) <= F.col("last"))).alias("scoreable"))


def extended(cal: DataFrame, requested: DataFrame) -> DataFrame:
    """cal with unobserved days up to the last requested origin of each field."""
    last = cal.groupBy("field").agg(F.max("date").alias("last"), F.max("t").alias("last_t"))
    far = requested.groupBy("field").agg(F.max("origin").alias("far")).join(last, "field").where("far > last")
    more = far.select("field", "last", "last_t", F.explode(F.sequence(F.date_add("last", 1), F.col("far"))).alias("date"))
    new = more.select("field", "date", (F.col("last_t") + F.datediff("date", "last")).alias("t"), F.lit(False).alias("observed"))
    return cal.unionByName(new, allowMissingColumns=True)


def evenly_spaced(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows of each field, evenly spaced by date from the first to the last."""
    w = Window.partitionBy("field").orderBy("date")
    m = rows.groupBy("field").agg(F.count("*").alias("m"))
    k = F.least(F.lit(n), F.col("m").cast("int"))
    at = m.select("field", F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * (F.col("m") - 1) / F.greatest(k - 1, F.lit(1)), 0).cast("int"))).alias("nth")).distinct()
    return rows.withColumn("nth", F.row_number().over(w) - 1).join(at, ["field", "nth"], "left_semi").drop("nth")


def latest_complete_origin(leads: DataFrame, cal: DataFrame) -> DataFrame:
    """(field, origin, complete): the latest origin with all its leads observed, else the latest of all. leads: field, origin, lead, target."""
    seen = cal.where("observed").select("field", F.col("date").alias("target"), F.lit(1).alias("hit"))
    whole = leads.join(seen, ["field", "target"], "left").groupBy("field", "origin").agg((F.count("hit") == F.count("*")).alias("complete"))
    return whole.groupBy("field").agg(F.max_by(F.struct("origin", "complete"), F.struct("complete", "origin")).alias("x")).select("field", "x.*")


def nearest_origins(origins: DataFrame, date: Column, n: int = 3) -> DataFrame:
    gap = F.abs(F.datediff("origin", date))
    return origins.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(gap, "origin"))).where(F.col("rank") <= n)


def best_by(rows: DataFrame, keys: list[str], choice: str, score: str) -> DataFrame:
    """keys, choice and score of the lowest score; the lowest choice among equals."""
    return rows.where(F.col(score).isNotNull()).groupBy(*keys).agg(F.min(F.struct(F.col(score), F.col(choice))).alias("x")).select(*keys, "x.*")


def ablation_summary(scores: DataFrame, reference: DataFrame) -> DataFrame:
    """(best_order, best_score, n_better, spread) from scores (order, score) and a reference row (reference)."""
    agg = scores.agg(F.min(F.struct("score", "order")).alias("b"), F.max("score").alias("hi"))
    n = scores.join(F.broadcast(reference)).agg(F.count_if(F.col("score") < F.col("reference")).alias("n_better"))
    return agg.join(n).select(F.col("b.order").alias("best_order"), F.col("b.score").alias("best_score"), "n_better", (F.col("hi") - F.col("b.score")).alias("spread"))


def error_budget(residuals: DataFrame, complement: DataFrame, persistence_rmse: DataFrame, gain: float) -> DataFrame:
    """(representation, truncation, static_complement, floor, upstream, persistence, binding): what the parts before the
    forecast cost, in the units of the data.

    residuals (residual) of the reconstruction; complement: the row of subspace.decoded_drift, or (field, t, pixel, part): what the
    subspace leaves out, decoded. Truncation is the one-step drift of that part; floor is gain times the root of the sum of squares.
    """
    moved = complement
    if "part" in complement.columns:
        step = F.col("part") - F.lag("part").over(Window.partitionBy("field", "pixel").orderBy("t"))
        moved = complement.withColumn("step", step).agg(F.sqrt(F.avg(F.col("step") * F.col("step"))).alias("truncation"), F.sqrt(F.avg(F.col("part") * F.col("part"))).alias("static_complement"))
    rep = residuals.agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("representation"))
    got = rep.join(F.broadcast(moved)).join(F.broadcast(persistence_rmse.select(F.col("rmse").alias("persistence"))))
    upstream = F.sqrt(F.col("representation") * F.col("representation") + F.col("truncation") * F.col("truncation"))
    binding = F.when(F.col("representation") >= F.col("truncation"), "representation").otherwise("truncation")
    return got.select("representation", "truncation", "static_complement", (F.lit(gain) * upstream).alias("floor"), upstream.alias("upstream"), "persistence", binding.alias("binding"))


def largest_norms(vectors: DataFrame, column: str) -> DataFrame:
    """(field, largest): the largest Euclidean norm of an array column."""
    return vectors.groupBy("field").agg(F.max(F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x))).alias("largest"))


def first_reaching(energies: DataFrame, keys: list[str], level: float) -> DataFrame:
    """keys, k: the first component at which the cumulative share of energy (keys, k, energy) is at least the level."""
    w = Window.partitionBy(*keys)
    share = energies.withColumn("share", F.sum("energy").over(w.orderBy("k")) / F.sum("energy").over(w))
    return share.where(F.col("share") >= level - 1e-12).groupBy(*keys).agg(F.min("k").alias("k"))
