"""Queries on calendars, masks, seasons and archive statistics, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.functions import dates as D
from fieldcast.operators import archive as A
from fieldcast.operators import fieldstats as S
from fieldcast.plans.panels import event_panel, fixed, item_panel, table, weather_record, with_sql

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def gap_calendar(spark, sf):
    """The item archive without frames of 20 valid cells or fewer: a calendar with gaps."""
    frames = A.frame_counts(item_panel(spark, sf), 100, 0.2).where("observed")
    return A.calendar(frames)


CUT_EV, CUT_LI = "2024-01-21", "2000-01-01"
_SPLIT = "CASE WHEN date < DATE '{0}' THEN 'train' ELSE 'test' END"


@query(with_sql("ev ev_days ev_cal", "SELECT field, date, t, observed FROM ev_cal"))
def calendar_densify(spark, sf):
    return A.calendar(event_panel(spark, sf))


@query(with_sql("li gap_days gap_cal", "SELECT field, date FROM gap_cal WHERE NOT observed"))
def gap_dates(spark, sf):
    return A.gap_dates(gap_calendar(spark, sf))


@query(with_sql("li gap_days", "SELECT DISTINCT field, date FROM gap_days WHERE date NOT BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'"))
def frames_outside(spark, sf):
    frames = A.frame_counts(item_panel(spark, sf), 100, 0.2).where("observed")
    return A.frames_outside(frames, A.calendar(frames, F.lit("1995-06-01").cast("date"), F.lit("2001-06-30").cast("date")))


@query("SELECT l_suppkey % 4 AS field, count(*) FILTER (l_extendedprice <> 901) AS n_valid, count(*) FILTER (l_extendedprice <> 901 AND NOT l_extendedprice BETWEEN 1000 AND 50000) AS n_out, round(count(*) FILTER (l_extendedprice <> 901 AND NOT l_extendedprice BETWEEN 1000 AND 50000) / count(*) FILTER (l_extendedprice <> 901) + 3e-8, 6) AS share FROM lineitem GROUP BY 1")
def validity_gate(spark, sf):
    pixels = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("field"), F.col("l_extendedprice").alias("value"))
    return A.out_of_range(pixels, 1000.0, 50000.0, nodata=901.0).withColumn("share", fixed("share", 6))


@query("SELECT l_suppkey % 4 AS field, CAST(l_shipdate AS DATE) AS date, count(*) FILTER (l_quantity BETWEEN 5 AND 45) AS n_valid, count(*) FILTER (l_quantity BETWEEN 5 AND 45) > 3 AS observed FROM lineitem GROUP BY ALL")
def drop_empty_frames(spark, sf):
    pixels = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("field"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").cast("double").alias("value"))
    return A.frame_counts(A.masked(pixels, lo=5.0, hi=45.0), 25, 0.1)


@query(with_sql("li gap_days gap_cal", """, g AS (SELECT *, t - row_number() OVER (PARTITION BY field, observed ORDER BY t) AS k FROM gap_cal)
SELECT field, observed, min(date) AS start, max(date) AS "end", count(*) AS length FROM g GROUP BY field, observed, k"""))
def observation_runs(spark, sf):
    return A.runs(gap_calendar(spark, sf))


@query(with_sql("li gap_days gap_cal", """, g AS (SELECT *, t - row_number() OVER (PARTITION BY field, observed ORDER BY t) AS k FROM gap_cal),
r AS (SELECT field, observed, count(*) AS n FROM g GROUP BY field, observed, k)
SELECT c.field, days, n_observed, days - n_observed AS missing, round(n_observed / days + 3e-8, 6) AS share, gap_runs, longest_gap, longest_run, n_observed / days < 0.5 AS warn
FROM (SELECT field, count(*) AS days, count(*) FILTER (observed) AS n_observed FROM gap_cal GROUP BY field) c
JOIN (SELECT field, count(*) FILTER (NOT observed) AS gap_runs, coalesce(max(n) FILTER (NOT observed), 0) AS longest_gap, coalesce(max(n) FILTER (observed), 0) AS longest_run FROM r GROUP BY field) r USING (field)"""))
def archive_coverage(spark, sf):
    return A.coverage_report(gap_calendar(spark, sf)).withColumn("share", fixed("share", 6))


_COV = ", nd AS (SELECT field, count(*) AS nd FROM ev_cal WHERE observed GROUP BY field), cov AS (SELECT field, pixel, count(value) AS n_valid, count(value) / any_value(nd) AS coverage FROM ev JOIN nd USING (field) GROUP BY field, pixel)"


@query(with_sql("ev ev_days ev_cal", _COV + " SELECT field, pixel, n_valid, round(coverage + 3e-8, 6) AS coverage FROM cov"))
def pixel_coverage(spark, sf):
    p = event_panel(spark, sf)
    return A.pixel_coverage(p, A.calendar(p)).withColumn("coverage", fixed("coverage", 6))


@query(with_sql("ev ev_days ev_cal", _COV + """, r AS (SELECT unnest([1.0, 0.99, 0.95, 0.9, 0.75, 0.5]) AS rung),
ok AS (SELECT field, rung FROM cov, r WHERE coverage >= rung GROUP BY field, rung HAVING count(*) >= 20),
lv AS (SELECT f.field, coalesce(max(rung), 1.0) AS level FROM (SELECT DISTINCT field FROM cov) f LEFT JOIN ok USING (field) GROUP BY f.field)
SELECT field, pixel, CAST(level AS DOUBLE) AS level FROM cov JOIN lv USING (field) WHERE coverage >= level"""))
def common_mask(spark, sf):
    p = event_panel(spark, sf)
    return A.common_mask(A.pixel_coverage(p, A.calendar(p)), min_pixels=20)


@query(with_sql("ev ev_days ev_cal", """, nd AS (SELECT field, count(*) AS nd FROM ev_cal WHERE observed GROUP BY field), nc AS (SELECT field, count(DISTINCT pixel) AS nc FROM ev GROUP BY field),
s AS (SELECT field, bool_and(n = nd) AS is_static FROM (SELECT field, pixel, count(value) AS n FROM ev GROUP BY ALL) JOIN nd USING (field) GROUP BY field),
d AS (SELECT c.field, c.date, coalesce(count(value), 0) / any_value(nc) AS share FROM ev_cal c LEFT JOIN ev USING (field, date) JOIN nc ON nc.field = c.field WHERE observed GROUP BY ALL)
SELECT field, any_value(is_static) AS is_static, round(min(share) + 3e-8, 6) AS min_share, round(max(share) + 3e-8, 6) AS max_share FROM d JOIN s USING (field) GROUP BY field"""))
def static_mask_test(spark, sf):
    p = event_panel(spark, sf)
    return A.static_mask(p, A.calendar(p), p.select("field", "pixel").distinct()).withColumns({c: fixed(c, 6) for c in ("min_share", "max_share")})


@query(with_sql("ev ev_days ev_cal", """, n AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY date) AS k, count(*) OVER (PARTITION BY field) AS n FROM ev_cal)
SELECT field, date, t, observed, CASE WHEN k <= greatest(2, least(CAST(round_even(0.85 * n, 0) AS INT), n - 1)) THEN 'train' ELSE 'test' END AS split FROM n"""))
def split_by_fraction(spark, sf):
    return A.split_by_fraction(A.calendar(event_panel(spark, sf)))


_SC = f", sc AS (SELECT field, avg(value) AS m, stddev_pop(value) AS s FROM ev JOIN ev_cal USING (field, date) WHERE observed AND date < DATE '{CUT_EV}' GROUP BY field)"


@query(with_sql("ev ev_days ev_cal", _SC + " SELECT field, date, pixel, round((value - m) / (s + 1e-6) + 3e-8, 6) AS value FROM ev JOIN sc USING (field)"))
def train_normalise(spark, sf):
    p = event_panel(spark, sf)
    return A.normalise(p, A.train_scale(p, A.split_by_date(A.calendar(p), CUT_EV))).withColumn("value", fixed("value", 6))


@query(with_sql("li", "SELECT field, round(min(value) + 3e-8, 6) AS min, round(quantile_cont(value, 0.001) + 3e-8, 6) AS p0_1, round(avg(value) + 3e-8, 6) AS mean, round(quantile_cont(value, 0.999) + 3e-8, 6) AS p99_9, round(max(value) + 3e-8, 6) AS max, round(stddev_pop(value) + 3e-8, 6) AS std FROM li GROUP BY field"))
def value_summary(spark, sf):
    return A.value_summary(item_panel(spark, sf)).select("field", *[fixed(c, 6).alias(c) for c in ("min", "p0_1", "mean", "p99_9", "max", "std")])


@query(with_sql("ev", ", q AS (SELECT field, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM ev GROUP BY field) SELECT field, round(CASE WHEN a = b THEN a - 0.5 ELSE a END + 3e-8, 6) AS lo, round(CASE WHEN a = b THEN b + 0.5 ELSE b END + 3e-8, 6) AS hi FROM q"))
def value_range(spark, sf):
    return A.value_range(event_panel(spark, sf)).select("field", fixed("lo", 6).alias("lo"), fixed("hi", 6).alias("hi"))


@query(with_sql("li gap_days gap_cal", """SELECT field, date, t, observed, min(observed::INT) OVER w = 1 AND count(*) OVER w = 4 AS window_ok FROM gap_cal
WINDOW w AS (PARTITION BY field ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"""))
def observed_window(spark, sf):
    return A.whole_window_observed(gap_calendar(spark, sf), 3, 1)


@query(with_sql("li gap_days gap_cal", f""", s AS (SELECT *, {_SPLIT.format(CUT_LI)} AS split FROM gap_cal)
SELECT field, date, t, observed, split, split = 'test' AND row_number() OVER (PARTITION BY field, split ORDER BY t) > 6 AS usable FROM s"""))
def purge_test_origins(spark, sf):
    return A.purge(A.split_by_date(gap_calendar(spark, sf), CUT_LI), 7)


@query(with_sql("li gap_days gap_cal", ", n AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY t) - 1 AS k FROM gap_cal) SELECT field, date, t, observed FROM n WHERE k % 5 = 0 AND observed"))
def strided_origins(spark, sf):
    return A.stride(gap_calendar(spark, sf), 5, keep=F.col("observed"))


_SEASON = """CASE WHEN month(date) BETWEEN 6 AND 9 THEN 'kharif' WHEN month(date) BETWEEN 3 AND 5 THEN 'zaid' ELSE 'rabi' END AS season,
 CASE WHEN month(date) <= 2 THEN year(date) - 1 ELSE year(date) END AS start_year"""
_INST = """, se AS (SELECT DISTINCT field, season, start_year FROM (SELECT field, """ + _SEASON + """ FROM {0})),
inst AS (SELECT *, CAST("end" - start AS INT) + 1 AS nominal_days,
  CASE season WHEN 'kharif' THEN 'Summer (Kharif) ' || start_year WHEN 'zaid' THEN 'Spring (Zaid) ' || start_year ELSE 'Winter (Rabi) ' || start_year || '/' || lpad(CAST((start_year + 1) % 100 AS VARCHAR), 2, '0') END AS label
 FROM (SELECT *, make_date(start_year, CASE season WHEN 'kharif' THEN 6 WHEN 'zaid' THEN 3 ELSE 10 END, 1) AS start,
  CASE season WHEN 'kharif' THEN make_date(start_year, 9, 30) WHEN 'zaid' THEN make_date(start_year, 5, 31) ELSE last_day(make_date(start_year + 1, 2, 1)) END AS "end" FROM se))"""


@query(with_sql("li li_days li_cal", _INST.format("li_cal") + ' SELECT field, season, start_year, start, "end", nominal_days, label FROM inst'))
def season_instances(spark, sf):
    return S.season_instances(A.calendar(item_panel(spark, sf))).orderBy("start")


@query(with_sql("li li_days li_cal", _INST.format("li_cal") + f""", w AS (SELECT field, {_SPLIT.format(CUT_LI)} AS split, min(date) AS a, max(date) AS b FROM li_cal GROUP BY ALL),
o AS (SELECT field, split, season, greatest(0, least("end", b) - greatest(start, a) + 1) / nominal_days AS share FROM inst JOIN w USING (field))
SELECT field, split, season, round(sum(share) + 3e-8, 6) AS coverage FROM o GROUP BY GROUPING SETS ((field, split, season), (field, split))"""))
def season_coverage(spark, sf):
    return S.season_coverage(A.split_by_date(A.calendar(item_panel(spark, sf)), CUT_LI)).withColumn("coverage", fixed("coverage", 6))


@query(f"SELECT date, {_SEASON}, round(cos(2 * pi() * (dayofyear(date) - 1) / 365.25) + 3e-8, 6) AS c1, round(sin(4 * pi() * (dayofyear(date) - 1) / 365.25) + 3e-8, 6) AS s2 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)")
def annual_phase(spark, sf):
    days = S.with_season(table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct())
    h = D.harmonics(F.col("date"))
    return days.withColumns({"c1": fixed(h[1], 6), "s2": fixed(h[4], 6)})


_STATS = """, st AS (SELECT {keys}, n, CASE WHEN n >= 3 THEN m END AS mean, CASE WHEN n >= 3 THEN v END AS variance, CASE WHEN n >= 3 THEN q2 END AS median, CASE WHEN n >= 3 THEN q3 - q1 END AS iqr,
 CASE WHEN n >= 3 AND abs(m) >= 1e-6 THEN sqrt(v) / m END AS cv, CASE WHEN n >= 3 AND abs(q2) >= 1e-6 THEN (q3 - q1) / abs(q2) END AS cv_robust
 FROM (SELECT {keys}, count(value) AS n, avg(value) AS m, var_samp(value) AS v, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM {table} GROUP BY {keys}))"""
_DIGEST = "count(*) AS n_pixels, round(avg(mean) + 3e-8, 6) AS mean_of_mean, round(avg(sqrt(variance)) + 3e-8, 6) AS mean_sd, round(quantile_cont(cv, 0.5) + 3e-8, 6) AS median_cv, round(avg((mean IS NULL)::INT) + 3e-8, 6) AS masked"
_NUM = ("mean", "variance", "median", "iqr", "cv", "cv_robust")


@query(with_sql("ev", _STATS.format(keys="field, pixel", table="ev") + " SELECT field, pixel, n, " + ", ".join(f"round({c} + 3e-8, 6) AS {c}" for c in _NUM) + " FROM st"))
def field_stats(spark, sf):
    return S.field_stats(event_panel(spark, sf), ["field", "pixel"]).select("field", "pixel", "n", *[fixed(c, 6).alias(c) for c in _NUM])


@query(with_sql("ev", _STATS.format(keys="field, pixel", table="ev") + f" SELECT field, {_DIGEST} FROM st GROUP BY field"))
def stats_digest(spark, sf):
    got = S.stats_digest(S.field_stats(event_panel(spark, sf), ["field", "pixel"]), ["field"])
    return got.select("field", "n_pixels", *[fixed(c, 6).alias(c) for c in ("mean_of_mean", "mean_sd", "median_cv", "masked")])


@query(with_sql("li", f", ss AS (SELECT *, {_SPLIT.format(CUT_LI)} AS split, {_SEASON} FROM li), fr AS (SELECT field, split, season, count(DISTINCT date) AS n_frames FROM ss GROUP BY ALL HAVING count(DISTINCT date) >= 20)" + _STATS.format(keys="field, split, season, pixel", table="ss") + f" SELECT field, split, season, any_value(n_frames) AS n_frames, {_DIGEST} FROM st JOIN fr USING (field, split, season) GROUP BY field, split, season"))
def season_field_stats(spark, sf):
    p = item_panel(spark, sf)
    got = S.season_report(p, A.split_by_date(A.calendar(p), CUT_LI))
    return got.select("field", "split", "season", "n_frames", "n_pixels", *[fixed(c, 6).alias(c) for c in ("mean_of_mean", "mean_sd", "median_cv", "masked")])


@query(with_sql("wx wx_days wx_cal", f"SELECT split, count(*) AS days, min(date) AS first, max(date) AS last FROM (SELECT *, {_SPLIT.format(CUT_LI)} AS split FROM wx_cal) GROUP BY split"))
def split_by_date(spark, sf):
    cal = A.split_by_date(A.calendar(weather_record(spark, sf)), CUT_LI)
    return cal.groupBy("split").agg(F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"))
