"""Queries on weather, forcing, grids and zones, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldcast.functions import dates as D
from fieldcast.functions import names as N
from fieldcast.operators import archive as A
from fieldcast.operators import raster as R
from fieldcast.operators import weather as W
from fieldcast.plans.archive_queries import CUT_LI, gap_calendar
from fieldcast.plans.panels import block_panel, fixed, item_panel, table, weather_record, with_sql
from fieldcast.sources import frames as SF
from fieldcast.sources.stages import stored

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(df, *cols):
    return df.withColumns({c: fixed(c, 6) for c in cols})


_DATE = r"""coalesce(try_strptime(regexp_extract(n, '(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})', 1) || regexp_extract(n, '(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})', 2) || regexp_extract(n, '(\d{4})[-_.]?(\d{2})[-_.]?(\d{2})', 3), '%Y%m%d')::DATE,
 CASE WHEN regexp_matches(n, '\d{4}[-_.]?\d{3}(?:\D|$)') THEN make_date(CAST(regexp_extract(n, '(\d{4})[-_.]?(\d{3})(?:\D|$)', 1) AS INT), 1, 1) + CAST(regexp_extract(n, '(\d{4})[-_.]?(\d{3})(?:\D|$)', 2) AS INT) - 1 END)"""
_FILES = "f AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'a/b/F_' || strftime(o_orderdate, '%Y%m%d') || '.tif' WHEN 1 THEN 'x/2001/G-' || strftime(o_orderdate, '%Y-%m-%d') || '_v2.tif' ELSE '/y/H' || strftime(o_orderdate, '%Y') || '.' || lpad(CAST(dayofyear(o_orderdate) AS VARCHAR), 3, '0') || '.tiff' END AS path FROM orders)"


def _files(spark, sf):
    day = F.col("o_orderdate")
    path = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("a/b/F_"), F.date_format(day, "yyyyMMdd"), F.lit(".tif")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("x/2001/G-"), F.date_format(day, "yyyy-MM-dd"), F.lit("_v2.tif")))
        .otherwise(F.concat(F.lit("/y/H"), F.date_format(day, "yyyy"), F.lit("."), F.lpad(F.dayofyear(day).cast("string"), 3, "0"), F.lit(".tiff")))
    )
    return table(spark, sf, "orders").select("o_orderkey", path.alias("path"))


@query(f"WITH {_FILES}, b AS (SELECT o_orderkey, path, string_split(path, '/')[-1] AS n FROM f) SELECT o_orderkey, {_DATE} AS date FROM b")
def parse_file_dates(spark, sf):
    return _files(spark, sf).select("o_orderkey", D.parse_date(F.col("path")).alias("date"))


@query(f"WITH {_FILES}, b AS (SELECT path, string_split(path, '/')[-1] AS n FROM f) SELECT date, count(*) AS n_files FROM (SELECT {_DATE} AS date FROM b) WHERE date IS NOT NULL GROUP BY date HAVING count(*) > 1")
def duplicate_frames(spark, sf):
    return SF.duplicate_dates(SF.dated(_files(spark, sf))).select("date", "n_files")


@query(with_sql("wx", "SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS name, count(*) AS n, p_brand LIKE 'Brand#1%' AS first FROM part GROUP BY ALL"))
def plain_names(spark, sf):
    own = table(spark, sf, "part").select(N.plain_col(F.col("p_brand")).alias("name"), F.startswith("p_brand", F.lit("Brand#1")).alias("first"))
    return own.groupBy("name", "first").agg(F.count("*").alias("n"))


@query(with_sql("wx", "SELECT CAST(date AS DATE) AS date, upper('ndvi') || '_forecast_' || strftime(date, '%Y-%m-%d') || '_t+' || CAST(precip AS INT) AS name FROM wx"))
def forecast_names(spark, sf):
    return weather_record(spark, sf).select("date", N.forecast_name(F.lit("ndvi"), F.col("date"), F.col("precip").cast("int")).alias("name"))


@query(with_sql("li li_days li_cal wx", "SELECT field, date FROM li_cal WHERE date NOT IN (SELECT date FROM wx)"))
def axis_dates_missing(spark, sf):
    return W.dates_missing(A.calendar(item_panel(spark, sf)), weather_record(spark, sf))


@query(with_sql("li li_days li_cal wx", """SELECT c.field, c.date, c.t, c.observed, w.date IS NOT NULL AS covered, coalesce(precip, 0) AS precip, CASE WHEN rs >= 2 THEN ta END AS ta, CASE WHEN rs >= 2 THEN rs END AS rs
FROM li_cal c LEFT JOIN wx w USING (field, date)"""))
def operational_weather(spark, sf):
    w = weather_record(spark, sf).withColumn("rs", F.when(F.col("rs") >= 2, F.col("rs")))
    return W.operational_join(A.calendar(item_panel(spark, sf)), w, ["ta", "rs"])


_FWD = """, ax AS (SELECT field, date, lead(date) OVER (PARTITION BY field ORDER BY date) AS nxt FROM gap_days),
dd AS (SELECT field, date, CAST(unnest(generate_series(greatest(date + 1, nxt - 31), nxt, INTERVAL 1 DAY)) AS DATE) AS day FROM ax WHERE nxt IS NOT NULL),
fw AS (SELECT ax.field, ax.date, coalesce(s, 0) AS precip, coalesce(m, 0) AS mean_ta, nxt IS NOT NULL AS forcing_valid FROM ax LEFT JOIN
 (SELECT dd.field, dd.date, sum(precip) AS s, avg(ta) AS m FROM dd JOIN wx ON wx.field = dd.field AND wx.date = dd.day GROUP BY ALL) USING (field, date))"""


@query(with_sql("li gap_days wx", _FWD + " SELECT field, date, precip, forcing_valid FROM fw"))
def forward_window_rain(spark, sf):
    axis = gap_calendar(spark, sf).where("observed")
    return W.forward_window(axis, weather_record(spark, sf), ["precip"])


@query(with_sql("li gap_days wx", _FWD + " SELECT field, date, round(mean_ta + 3e-8, 6) AS ta, forcing_valid FROM fw"))
def irrigation_windows(spark, sf):
    axis = gap_calendar(spark, sf).where("observed")
    return _r(W.forward_window(axis, weather_record(spark, sf), ["ta"], how="mean"), "ta")


@query(with_sql("li gap_days wx", _FWD + " SELECT field, date, precip, forcing_valid, coalesce(lag(precip) OVER w, 0) AS precip_lag1, coalesce(lag(precip, 2) OVER w, 0) AS precip_lag2 FROM fw WINDOW w AS (PARTITION BY field ORDER BY date)"))
def lag_channels(spark, sf):
    axis = gap_calendar(spark, sf).where("observed")
    return W.lag_channels(W.forward_window(axis, weather_record(spark, sf), ["precip"]), ["precip"], 2)


@query(with_sql("wx", """, a AS (SELECT field, date, CASE WHEN precip < 2 THEN NULL ELSE ta END AS ta, row_number() OVER (PARTITION BY field ORDER BY date) AS pos FROM wx),
b AS (SELECT field, date, ta, pos, last_value(ta IGNORE NULLS) OVER w0 AS v0, last_value(CASE WHEN ta IS NOT NULL THEN pos END IGNORE NULLS) OVER w0 AS p0,
 first_value(ta IGNORE NULLS) OVER w1 AS v1, first_value(CASE WHEN ta IS NOT NULL THEN pos END IGNORE NULLS) OVER w1 AS p1 FROM a
 WINDOW w0 AS (PARTITION BY field ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w1 AS (PARTITION BY field ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT field, date, round(coalesce(ta, v0 + (v1 - v0) * (pos - p0) / nullif(p1 - p0, 0), v0, v1) + 3e-10, 8) AS ta FROM b"""))
def interpolated_weather(spark, sf):
    w = weather_record(spark, sf).select("field", "date", F.when(F.col("precip") >= 2, F.col("ta")).alias("ta"))
    return W.interpolated(w, ["ta"]).withColumn("ta", fixed("ta", 8))


@query(with_sql("wx", f"SELECT field, round(avg((abs(precip) <= 1e-8)::INT) + 3e-8, 6) AS quiescent, round(avg((precip <> 0)::INT) + 3e-8, 6) AS precip_nonzero, round(avg(precip) + 3e-8, 6) AS precip_mean, round(max(precip) + 3e-8, 6) AS precip_max FROM wx GROUP BY field"))
def forcing_summary(spark, sf):
    return _r(W.forcing_summary(weather_record(spark, sf), ["precip"]), "quiescent", "precip_nonzero", "precip_mean", "precip_max")


@query(with_sql("wx", ", q AS (SELECT field, count(*) FILTER (abs(precip) <= 1e-8) AS nq FROM wx GROUP BY field) SELECT field, date, precip FROM wx JOIN q USING (field) WHERE abs(precip) <= 1e-8 OR nq < 32"))
def quiescent_days(spark, sf):
    return W.quiescent_transitions(weather_record(spark, sf), ["precip"], 7).select("field", "date", "precip")


@query(with_sql("wx", "SELECT 'precip' AS a, 'ta' AS b, round(corr(precip, ta) + 3e-8, 6) AS corr FROM wx UNION ALL SELECT 'precip', 'vpd', round(corr(precip, vpd) + 3e-8, 6) FROM wx UNION ALL SELECT 'ta', 'vpd', round(corr(ta, vpd) + 3e-8, 6) FROM wx"))
def channel_correlations(spark, sf):
    return _r(W.correlations(weather_record(spark, sf), ["precip", "ta", "vpd"]), "corr")


@query(with_sql("wx", ", c AS (SELECT unnest([{'a': 'precip', 'b': 'ta', 'corr': corr(precip, ta)}, {'a': 'precip', 'b': 'vpd', 'corr': corr(precip, vpd)}, {'a': 'ta', 'b': 'vpd', 'corr': corr(ta, vpd)}]) AS x FROM wx) SELECT x.a, x.b, round(x.corr + 3e-8, 6) AS corr, abs(x.corr) > 0.9 AS warn FROM c ORDER BY abs(x.corr) DESC LIMIT 1"))
def worst_correlation(spark, sf):
    return _r(W.worst_correlation(W.correlations(weather_record(spark, sf), ["precip", "ta", "vpd"])), "corr")


_H = ["1.0", *[f"{f}({k} * 2 * pi() * (dayofyear(date) - 1) / 365.25)" for k in (1, 2) for f in ("cos", "sin")]]
_MOM = ", ".join(f"{{'i': {i}, 'j': {j}, 'value': round(sum({a} * {b}) + 3e-8, 6)}}" for i, a in enumerate(_H) for j, b in enumerate([*_H, "ta"]))


@query(with_sql("wx", f", m AS (SELECT field, unnest([{_MOM}]) AS x FROM wx WHERE date < DATE '{CUT_LI}' GROUP BY field) SELECT field, x.i, x.j, x.value + 0.0 AS value FROM m"))
def climatology_moments(spark, sf):
    early = weather_record(spark, sf).where(F.col("date") < F.lit(CUT_LI).cast("date"))
    return W.climatology_moments(early, ["ta"]).withColumn("value", fixed("value", 6) + 0.0)


@query(None)
def climatology_fit(spark, sf):
    """Coefficients and amplitudes by channel: tested against NumPy."""
    early = weather_record(spark, sf).where(F.col("date") < F.lit(CUT_LI).cast("date"))
    return W.fit_climatology(early, ["ta", "rs", "vpd"]).withColumn("amplitude", W.amplitude(F.col("coef")))


@query(None)
def weather_build(spark, sf):
    """The whole weather table: forcing scaled, measures as scaled anomalies."""
    w = weather_record(spark, sf)
    axis = gap_calendar(spark, sf).where("observed").select("field", "date").join(w.select("field", "date"), ["field", "date"], "left_semi")
    return W.build_weather(axis, w, ["ta", "rs", "vpd"], CUT_LI)[0]


@query(with_sql("wx", "SELECT n_name AS name, CASE WHEN n_name LIKE 'precip%' THEN 'disturbance' ELSE 'actuator' END AS role FROM nation UNION ALL SELECT 'precip_lag1', 'disturbance'"))
def channel_roles(spark, sf):
    own = table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(spark.createDataFrame([("precip_lag1",)], "name string"))
    return W.roles(own)


AFFINE = (30.0, 0.0, 500000.0, 0.0, -30.0, 3400000.0)


def _grid(spark, sf):
    return item_panel(spark, sf).select("field", "pixel", "row", "col").distinct()


@query(with_sql("li", """, g AS (SELECT DISTINCT field, pixel, row, col, (col + 0.5) * 30.0 + 500000.0 AS mx, (row + 0.5) * -30.0 + 3400000.0 AS my FROM li)
SELECT field, pixel, row, col, round(coalesce(2 * (mx - min(mx) OVER w) / nullif(max(mx) OVER w - min(mx) OVER w, 0) - 1, 0) + 3e-8, 6) AS x, round(coalesce(2 * (my - min(my) OVER w) / nullif(max(my) OVER w - min(my) OVER w, 0) - 1, 0) + 3e-8, 6) AS y FROM g WINDOW w AS (PARTITION BY field)"""))
def unit_coordinates(spark, sf):
    return _r(R.unit_coordinates(_grid(spark, sf), AFFINE), "x", "y")


@query("""SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN sqrt(0.001 * abs(lo) * 0.002 * abs(la)) WHEN c_custkey % 3 = 1 THEN 30.0 ELSE 25.0 END + 3e-8, 6) AS metres
FROM (SELECT c_custkey, 111132.92 - 559.82 * cos(2 * f) AS la, 111412.84 * cos(f) - 93.5 * cos(3 * f) AS lo FROM (SELECT c_custkey, radians(c_nationkey * 3.0) AS f FROM customer))""")
def pixel_metres(spark, sf):
    """Oblong pixels in degrees, projected ones, and ones without a step."""
    c = table(spark, sf, "customer")
    kind = F.col("c_custkey") % 3
    dx = F.when(kind == 0, 0.001).when(kind == 1, -30.0).otherwise(0.0)
    return c.select("c_custkey", fixed(R.pixel_metres(dx, F.when(kind == 0, -0.002).otherwise(-60.0), kind == 0, F.col("c_nationkey") * 3.0, 25.0), 6).alias("metres"))


_SIZES = "sz AS (SELECT field, max(row) + 1 AS h, max(col) + 1 AS w FROM lb GROUP BY field)"


@query(with_sql("li lb", f", {_SIZES}, k AS (SELECT field, h, w, greatest(1, round_even(h * f, 0)) AS th, greatest(1, round_even(w * f, 0)) AS tw FROM (SELECT *, least(1.0, sqrt(25.0 / (h * w))) AS f FROM sz)) SELECT field, date, CAST(floor(row * th / h) AS INT) AS row, CAST(floor(col * tw / w) AS INT) AS col, round(avg(value) + 3e-8, 6) AS value FROM lb JOIN k USING (field) GROUP BY ALL"))
def thinned_grid(spark, sf):
    return _r(R.thinned(block_panel(spark, sf), 25), "value")


@query(with_sql("li li_days li_cal", """, sz AS (SELECT max(row) + 1 AS h, max(col) + 1 AS w FROM li), z AS (SELECT DISTINCT field, pixel, CAST(least(floor(row * 2 / h) * 3 + floor(col * 3 / w), 5) AS INT) AS zone FROM li, sz),
m AS (SELECT field, date, zone, avg(value) AS v FROM li JOIN z USING (field, pixel) GROUP BY ALL)
SELECT c.field, c.date, zz.zone, round(coalesce(v, 0) + 3e-8, 6) AS value FROM li_cal c JOIN (SELECT DISTINCT field, zone FROM z) zz USING (field) LEFT JOIN m USING (field, date, zone)"""))
def zonal_means(spark, sf):
    p = item_panel(spark, sf)
    return _r(R.zonal_means(p, R.zones(_grid(spark, sf), 6), A.calendar(p)), "value")


@query(with_sql("li li_days li_cal", ", m AS (SELECT field, date, avg(value) AS v FROM li GROUP BY ALL) SELECT c.field, c.date, round(coalesce(v, 0) + 3e-8, 6) AS value FROM li_cal c LEFT JOIN m USING (field, date)"))
def area_means(spark, sf):
    p = item_panel(spark, sf)
    return _r(R.area_means(p, A.calendar(p)), "value")


COARSE = (90.0, 0.0, 499950.0, 0.0, -90.0, 3400060.0)
_COARSE = ", co AS (SELECT field, date, CAST(floor(row / 3) AS INT) AS row, CAST(floor(col / 3) AS INT) AS col, round(avg(value) + 3e-8, 6) AS value FROM lb GROUP BY ALL), ta AS (SELECT field, row, col, ((col + 0.5) * 30.0 + 500000.0 - 499950.0) / 90.0 - 0.5 AS sj, ((row + 0.5) * -30.0 + 3400000.0 - 3400060.0) / -90.0 - 0.5 AS si FROM (SELECT DISTINCT field, row, col FROM lb))"


def _coarse(p):
    return p.groupBy("field", "date", F.floor(F.col("row") / 3).cast("int").alias("row"), F.floor(F.col("col") / 3).cast("int").alias("col")).agg(fixed(F.avg("value"), 6).alias("value"))


def _target(p):
    return p.select("field", "row", "col").distinct()


def _panel(spark, sf):
    """The block archive, worked out once for all that a query does with it."""
    return stored(block_panel(spark, sf), "panel")


@query(with_sql("li lb", _COARSE + " SELECT ta.field, co.date, ta.row, ta.col, co.value FROM ta JOIN co ON co.field = ta.field AND co.row = CAST(floor(si + 0.5) AS INT) AND co.col = CAST(floor(sj + 0.5) AS INT)"))
def align_nearest(spark, sf):
    p = _panel(spark, sf)
    return R.aligned(_coarse(p), _target(p), AFFINE, COARSE, "nearest")


def _weighted(k: str, reach: str) -> str:
    """SQL of the weighted mean of the cells within reach; di and dj are the distances to a cell."""
    return f""", c4 AS (SELECT *, {k} AS k FROM (SELECT field, row, col, CAST(floor(si) AS INT) + i AS sr, CAST(floor(sj) AS INT) + j AS sc, abs(si - floor(si) - i) AS di, abs(sj - floor(sj) - j) AS dj FROM ta, (SELECT unnest({reach}) AS i), (SELECT unnest({reach}) AS j)))
SELECT c4.field, co.date, c4.row, c4.col, round(greatest(sum(k * co.value) / sum(k), 0) + 3e-8, 6) AS value FROM c4 JOIN co ON co.field = c4.field AND co.row = sr AND co.col = sc WHERE k <> 0 GROUP BY ALL"""


@query(with_sql("li lb", _COARSE + _weighted("(1 - di) * (1 - dj)", "[0, 1]")))
def align_bilinear(spark, sf):
    p = _panel(spark, sf)
    return _r(R.aligned(_coarse(p), _target(p), AFFINE, COARSE, "bilinear"), "value")


@query(with_sql("li lb", """, ce AS (SELECT field, date, CAST(floor(((row + 0.5) * -30.0 - 60.0) / -90.0) AS INT) AS row, CAST(floor(((col + 0.5) * 30.0 + 50.0) / 90.0) AS INT) AS col, value FROM lb) SELECT field, date, row, col, round(avg(value) + 3e-8, 6) AS value FROM ce GROUP BY ALL"""))
def align_average(spark, sf):
    """Onto all coarse cells that the fine grids touch."""
    x, y = R.map_coordinates(F.col("row"), F.col("col"), AFFINE)
    p = _panel(spark, sf)
    grid = _target(p).select("field", F.floor((y - COARSE[5]) / COARSE[4]).cast("int").alias("row"), F.floor((x - COARSE[2]) / COARSE[0]).cast("int").alias("col")).distinct()
    return _r(R.aligned(p, grid, COARSE, AFFINE, "average"), "value")


_CUBIC = "(CASE WHEN {0} <= 1 THEN 1.5 * {0} * {0} * {0} - 2.5 * {0} * {0} + 1 WHEN {0} < 2 THEN -0.5 * {0} * {0} * {0} + 2.5 * {0} * {0} - 4 * {0} + 2 ELSE 0 END)"


@query(with_sql("li lb", _COARSE + _weighted(f"{_CUBIC.format('di')} * {_CUBIC.format('dj')}", "[-1, 0, 1, 2]")))
def align_cubic(spark, sf):
    p = _panel(spark, sf)
    return _r(R.aligned(_coarse(p), _target(p), AFFINE, COARSE, "cubic"), "value")


#: A coarse grid in degrees of longitude and latitude over the same ground.
DEGREES = (0.001, 0.0, 74.998, 0.0, -0.001, 30.733)
ZONE = 43


@query(None)
def align_projected(spark, sf):
    """A grid in degrees on a projected one, bilinear; tested against a loop over cells and the projection's inverse."""
    p = _panel(spark, sf)
    return R.aligned(_coarse(p), _target(p), AFFINE, DEGREES, "bilinear", project=lambda x, y: R.from_utm(x, y, ZONE))


@query(None)
def distinct_picks(spark, sf):
    """A pixel of its own for each nation's place; tested against a loop that takes them one after another."""
    c = table(spark, sf, "nation").select(F.lit(0).cast("long").alias("field"), F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 3 * 2.1).alias("cx"), (F.col("n_nationkey") % 4 * 1.3).alias("cy"))
    return R.distinct_pixels(_grid(spark, sf).withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")}), c)


@query(with_sql("li", """, g AS (SELECT DISTINCT pixel, row, col FROM li), c AS (SELECT DISTINCT r_regionkey AS k, r_regionkey * 2.1 AS cx, r_regionkey * 1.3 AS cy FROM region)
SELECT CAST(0 AS BIGINT) AS field, k, pixel FROM (SELECT k, pixel, row_number() OVER (PARTITION BY k ORDER BY (col - cx) * (col - cx) + (row - cy) * (row - cy), pixel) AS n FROM g, c) WHERE n = 1"""))
def nearest_pixels(spark, sf):
    c = table(spark, sf, "region").select(F.lit(0).cast("long").alias("field"), F.col("r_regionkey").alias("k"), (F.col("r_regionkey") * 2.1).alias("cx"), (F.col("r_regionkey") * 1.3).alias("cy"))
    return R.nearest_pixel(_grid(spark, sf).withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")}), c)


@query(None)
def weather_summary(spark, sf):
    """Quiet share, annual amplitude against residual spread, by channel; built on climatology_fit, tested there."""
    w = weather_record(spark, sf)
    axis = w.select("field", "date")
    built, climate = W.build_weather(axis, w, ["ta", "rs"], CUT_LI, lags=1)
    return W.weather_summary(built, ["ta", "rs"], climate, ["precip", "precip_lag1"], CUT_LI)
