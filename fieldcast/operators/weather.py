"""Point weather and forcing: joins by date, forward windows, lags, interpolation, climatology."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.functions.dates import harmonics
from fieldcast.functions.linalg import ridge

#: Days that a forward window goes back from its end at most. Fixed value.
MAX_ACCUM_DAYS = 32


def dates_missing(axis: DataFrame, source: DataFrame) -> DataFrame:
    """(field, date) of the axis that the source lacks."""
    return axis.select("field", "date").distinct().join(source.select("field", "date").distinct(), ["field", "date"], "left_anti")


def join_by_date(axis: DataFrame, source: DataFrame) -> DataFrame:
    """axis with the source's columns of the same date, never of the same position; a date that the source lacks is an error."""
    lost = dates_missing(axis, source).orderBy("field", "date").limit(5).collect()
    if lost:
        raise ValueError(f"dates without a source row, such as {[str(r.date) for r in lost]}")
    return axis.join(source, ["field", "date"], "left")


def operational_join(axis: DataFrame, source: DataFrame, measures: list[str], rain: str = "precip") -> DataFrame:
    """axis with covered, the rain (0 where missing) and the measures (all null unless all are known)."""
    whole = F.lit(True)
    for m in measures:
        whole = whole & F.col(m).isNotNull() & ~F.isnan(F.col(m))
    got = axis.join(source.select("field", "date", rain, *measures, F.lit(True).alias("there")), ["field", "date"], "left")
    return got.select(*axis.columns, F.coalesce("there", F.lit(False)).alias("covered"), F.coalesce(rain, F.lit(0.0)).alias(rain), *[F.when(whole, F.col(m)).alias(m) for m in measures])


def next_date(axis: DataFrame) -> DataFrame:
    return axis.withColumn("next_date", F.lead("date").over(Window.partitionBy("field").orderBy("date")))


def forward_window(axis: DataFrame, daily: DataFrame, columns: list[str], how: str = "sum", most: int = MAX_ACCUM_DAYS) -> DataFrame:
    """For each axis date the sum or mean of the daily columns over (date, next date], and forcing_valid.

    The window reaches back from its end at most `most` days; missing days add nothing; an empty window and the
    last date give 0, the last date with forcing_valid false. The interval join is made an equi-join on the days.
    """
    spans = next_date(axis.select("field", "date").distinct())
    days = spans.where("next_date is not null").select(
        "field", "date", F.explode(F.sequence(F.greatest(F.date_add("date", 1), F.date_sub("next_date", most - 1)), F.col("next_date"))).alias("day")
    )
    agg = {"sum": F.sum, "mean": F.avg}[how]
    sums = days.join(daily.select("field", F.col("date").alias("day"), *columns), ["field", "day"]).groupBy("field", "date").agg(*[agg(c).alias(c) for c in columns])
    out = spans.join(sums, ["field", "date"], "left")
    return out.select("field", "date", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns], F.col("next_date").isNotNull().alias("forcing_valid"))


def lag_channels(table: DataFrame, columns: list[str], order: int) -> DataFrame:
    """table with c_lag1 .. c_lag{order} for each column, 0 before the start."""
    w = Window.partitionBy("field").orderBy("date")
    return table.select("*", *[F.coalesce(F.lag(c, k).over(w), F.lit(0.0)).alias(f"{c}_lag{k}") for c in columns for k in range(1, order + 1)])


def interpolated(table: DataFrame, columns: list[str]) -> DataFrame:
    """table with inner nulls put on a line by row position, and the ends filled with the nearest value.

    A channel without any value in a field is an error.
    """
    empty = table.groupBy("field").agg(*[F.count(c).alias(c) for c in columns])
    for r in empty.where(" or ".join(f"`{c}` = 0" for c in columns)).limit(1).collect():
        raise ValueError(f"a channel of field {r.field} has no value")
    order = Window.partitionBy("field").orderBy("date")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    out = table.withColumn("pos", F.row_number().over(order))
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col("pos"))
        p0, p1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
        v0, v1 = F.last(c, True).over(back), F.first(c, True).over(ahead)
        line = v0 + (v1 - v0) * F.try_divide(F.col("pos") - p0, p1 - p0)
        out = out.withColumn(c, F.coalesce(F.col(c), line, v0, v1))
    return out.drop("pos")


def roles(channels: DataFrame) -> DataFrame:
    """channels (name) with role: rain is a disturbance, the rest actuators."""
    return channels.withColumn("role", F.when(F.startswith("name", F.lit("precip")), "disturbance").otherwise("actuator"))


def quiescent(forcing: list[str], tolerance: float = 1e-8) -> Column:
    total = F.lit(0.0)
    for c in forcing:
        total = total + F.abs(F.col(c))
    return total <= tolerance


def quiescent_transitions(table: DataFrame, forcing: list[str], order: int = 1) -> DataFrame:
    """table's rows without forcing; all rows of a field with fewer than max(4 * order, 32) of them."""
    n = table.groupBy("field").agg(F.count_if(quiescent(forcing)).alias("n_quiet"))
    return table.join(n, "field").where(quiescent(forcing) | (F.col("n_quiet") < max(4 * order, 32)))


def forcing_summary(table: DataFrame, forcing: list[str]) -> DataFrame:
    """A row for each field: quiescent share, and for each channel the share of non-zero rows, mean and maximum."""
    each = [x for c in forcing for x in (F.avg((F.col(c) != 0).cast("int")).alias(f"{c}_nonzero"), F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max"))]
    return table.groupBy("field").agg(F.avg(quiescent(forcing).cast("int")).alias("quiescent"), *each)


def correlations(table: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of each pair of channels."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = table.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def worst_correlation(pairs: DataFrame, limit: float = 0.9) -> DataFrame:
    top = pairs.agg(F.max_by(F.struct("a", "b", "corr"), F.abs("corr")).alias("x")).select("x.*")
    return top.withColumn("warn", F.abs("corr") > limit)


def climatology_moments(table: DataFrame, columns: list[str], order: int = 2) -> DataFrame:
    """(field, i, j, value): sums of products of the harmonic columns with each other and (j >= 2 order + 1) with the channels."""
    x = harmonics(F.col("date"), order)
    p = len(x)
    known = table.where(" and ".join(f"{c} is not null" for c in columns))
    sums = [F.sum(x[i] * y).alias(f"m_{i}_{j}") for i in range(p) for j, y in enumerate([*x, *[F.col(c) for c in columns]])]
    row = known.groupBy("field").agg(*sums)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m_{i}_{j}").alias("value")) for i in range(p) for j in range(p + len(columns))])
    return row.select("field", F.explode(cells).alias("x")).select("field", "x.*")


def fit_climatology(train: DataFrame, columns: list[str], order: int = 2) -> DataFrame:
    """(field, channel, coef): least squares of each channel on the annual harmonics, over the rows of train alone."""
    p = 2 * order + 1
    moments = climatology_moments(train, columns, order).toPandas()  # (2 order + 1) numbers a channel and field
    rows = []
    for field, f in moments.groupby("field"):
        m = np.zeros((p, p + len(columns)))
        m[f["i"], f["j"]] = f["value"]
        coef = ridge(m[:, :p], m[:, p:], 0.0)
        rows += [(field, c, coef[:, k].tolist()) for k, c in enumerate(columns)]
    kind = dict(train.dtypes)["field"]
    return train.sparkSession.createDataFrame(rows, f"field {kind}, channel string, coef array<double>")


def climatology_at(date: Column, coef: Column, order: int = 2) -> Column:
    out = F.lit(0.0)
    for i, h in enumerate(harmonics(date, order)):
        out = out + h * coef[i]
    return out


def amplitude(coef: Column) -> Column:
    """Peak to peak of the first harmonic."""
    return 2 * F.sqrt(coef[1] * coef[1] + coef[2] * coef[2])


def anomalies(table: DataFrame, columns: list[str], climate: DataFrame, order: int = 2) -> DataFrame:
    """table with each channel less its climatology."""
    wide = climate.groupBy("field").pivot("channel", columns).agg(F.first("coef"))
    wide = wide.select("field", *[F.col(c).alias(f"{c}_coef") for c in columns])
    got = table.join(wide, "field")
    return got.withColumns({c: F.col(c) - climatology_at(F.col("date"), F.col(f"{c}_coef"), order) for c in columns}).drop(*[f"{c}_coef" for c in columns])


def build_weather(axis: DataFrame, daily: DataFrame, measures: list[str], cut: str, lags: int = 2, rain: str = "precip") -> tuple[DataFrame, DataFrame]:
    """(weather, climate): forcing summed forward with its lags and scaled, never centred; measures as scaled anomalies.

    Everything that is estimated comes from rows before `cut`: climatology, and standard deviations (1 where they
    are 1e-8 or less).
    """
    filled = interpolated(daily, measures)
    window = lag_channels(forward_window(axis, filled, [rain]), [rain], lags)
    forcing = [rain, *[f"{rain}_lag{k}" for k in range(1, lags + 1)]]
    table = join_by_date(window, filled.select("field", "date", *measures))
    early = F.col("date") < F.lit(cut).cast("date")
    climate = fit_climatology(table.where(early), measures)
    table = anomalies(table, measures, climate)
    sd = table.groupBy("field").agg(*[F.stddev_pop(F.when(early, F.col(c))).alias(f"{c}_sd") for c in (*forcing, *measures)])
    scaled = table.join(sd, "field")
    one = lambda c: F.when(F.col(f"{c}_sd") > 1e-8, F.col(f"{c}_sd")).otherwise(1.0)
    return scaled.withColumns({c: F.col(c) / one(c) for c in (*forcing, *measures)}), climate


def unscaled(table: DataFrame, columns: list[str], offset: dict[str, Column] | None = None) -> DataFrame:
    """Undoes the scaling by the c_sd columns, and adds back an offset (the climatology) where given."""
    back = lambda c: F.col(c) * F.when(F.col(f"{c}_sd") > 1e-8, F.col(f"{c}_sd")).otherwise(1.0)
    return table.withColumns({c: back(c) + (offset or {}).get(c, F.lit(0.0)) for c in columns})


def weather_summary(table: DataFrame, measures: list[str], climate: DataFrame, forcing: list[str], cut: str) -> DataFrame:
    """(field, channel, quiescent, amplitude, residual_sd, ratio): over the usable training rows of build_weather()."""
    early = table.where(F.col("forcing_valid") & (F.col("date") < F.lit(cut).cast("date")))
    quiet = early.groupBy("field").agg(F.avg(quiescent(forcing).cast("int")).alias("quiescent"), *[F.max(f"{c}_sd").alias(c) for c in measures])
    long = quiet.select("field", "quiescent", F.explode(F.create_map(*[x for c in measures for x in (F.lit(c), F.col(c))])).alias("channel", "residual_sd"))
    return long.join(climate, ["field", "channel"]).select("field", "channel", "quiescent", amplitude(F.col("coef")).alias("amplitude"), "residual_sd", F.try_divide(amplitude(F.col("coef")), F.col("residual_sd")).alias("ratio"))
