"""The streaming jobs over the events table, run over all that is there; windows still open at the end are not given out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.plans.panels import fixed, table
from fieldcast.streaming import jobs as J

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream: a user is a zone of one of three fields."""
    batch = table(spark, sf, "events")
    # A stream reads folders: the table's own, or the one that the table's single file lies in.
    folder, name = batch.inputFiles()[0].rsplit("/", 1)
    reader = spark.readStream.schema(batch.schema)
    raw = (reader if folder.endswith("events.parquet") else reader.option("pathGlobFilter", name)).parquet(folder)
    return raw.select("user_id", (F.col("user_id") % 3).alias("field"), (F.col("user_id") % 12).alias("zone"), F.col("ts").cast("timestamp").alias("ts"), "value")


_OPEN = "CAST(ts AS DATE) + 1 <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY"


@query(f"SELECT user_id % 3 AS field, user_id % 12 AS zone, CAST(ts AS DATE) AS day, round(avg(value) + 3e-8, 6) AS value, count(value) AS n FROM events WHERE {_OPEN} GROUP BY ALL")
def stream_daily_means(spark, sf):
    return J.run_to_table(J.daily_means(_events(spark, sf)), "means").withColumn("value", fixed("value"))


@query(f"SELECT user_id % 3 AS field, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE {_OPEN} GROUP BY ALL HAVING count(*) > 1")
def stream_repeated_frames(spark, sf):
    return J.run_to_table(J.repeated_frames(_events(spark, sf)), "repeats")


@query("""WITH e AS (SELECT user_id % 3 AS field, CAST(ts AS DATE) AS day, value FROM events), w AS (SELECT field, day + CAST(k AS INT) AS "end", value FROM e, (SELECT unnest(generate_series(1, 8)) AS k))
SELECT field, "end", round(sum(value) + 3e-6, 4) AS total FROM w WHERE "end" <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY GROUP BY ALL""")
def stream_trailing_totals(spark, sf):
    return J.run_to_table(J.trailing_totals(_events(spark, sf), 8), "totals").withColumn("total", fixed("total", 4))


@query("""WITH d AS (SELECT DISTINCT user_id AS field, CAST(ts AS DATE) AS day FROM events), g AS (SELECT field, day, day - CAST(row_number() OVER (PARTITION BY field ORDER BY day) AS INT) AS run FROM d)
SELECT field, min(day) AS first, max(day) AS last, CAST(count(*) AS INT) AS days, count(*) >= 3 AS enough FROM g GROUP BY field, run HAVING max(day) + 2 <= (SELECT max(CAST(ts AS DATE)) FROM events) - 3""")
def stream_observed_runs(spark, sf):
    """Runs of days with events of each user; the last run of a user, which may go on, is not given out."""
    return J.run_to_table(J.observed_runs(_events(spark, sf).withColumn("field", F.col("user_id")), 3), "runs")


def _daily(spark, sf):
    e = _events(spark, sf).withWatermark("ts", "3 days")
    return e.groupBy(F.window("ts", "1 day"), F.col("user_id").alias("field")).agg(F.avg("value").alias("value"))


@query("""WITH d AS (SELECT user_id AS field, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY ALL)
SELECT f.field, f.day + 1 AS day, round(f.value + 3e-8, 6) AS pred, round(t.value + 3e-8, 6) AS value FROM d f LEFT JOIN d t ON f.field = t.field AND t.day = f.day + 1 WHERE f.day + 2 <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY""")
def stream_live_scores(spark, sf):
    """Forecasts of each user's next day, met with that day when it closes; null where it passed without events."""
    got = J.run_to_table(J.chained_scores(_daily(spark, sf), _daily(spark, sf)), "scores")
    return got.withColumns({c: fixed(c) for c in ("pred", "value")})


#: A memory model of two components, mean and largest value of a day, as a stored one would be read.
_MODEL = {"A": [[[0.5, 0.1], [0.0, 0.4]], [[0.2, 0.0], [0.1, 0.2]]], "Q": [[4.0, 1.0], [1.0, 9.0]], "R": [[2.0, 0.0], [0.0, 4.0]]}


@query(None)
def stream_live_forecasts(spark, sf):
    """Forecasts for each user from the daily means and maxima of its events, as the days close; tested against the batch filter."""
    e = _events(spark, sf).withWatermark("ts", "1 day")
    daily = e.groupBy(F.window("ts", "1 day"), F.col("user_id").alias("field")).agg(F.array(F.avg("value"), F.max("value")).alias("w"))
    frames = daily.select("field", F.window_time("window").alias("ts"), "w")
    path = J.run_to_table(frames, "frames")
    # The days' frames are a stream of their own, as they would be written by another job.
    again = spark.readStream.schema(path.schema).parquet(path.inputFiles()[0].rsplit("/", 1)[0]) if path.limit(1).count() else None
    if again is None:
        return spark.createDataFrame([], J.LIVE)
    with J.rocks(spark):
        return J.run_to_table(J.live_filter(again, _MODEL, 3), "live")
