"""Forward windows, interpolation, climatology, alignment."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.operators import raster as R
from fieldcast.operators import weather as W
from fieldcast.sources import frames as SF

DAY = dt.date(2022, 1, 1)


def daily(spark, values, name="precip", field=0):
    return spark.createDataFrame([(field, DAY + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], f"field long, date date, {name} double")


def test_forward_window_is_open_at_its_start(spark):
    axis = spark.createDataFrame([(0, DAY), (0, DAY + dt.timedelta(8)), (0, DAY + dt.timedelta(16))], "field long, date date")
    got = W.forward_window(axis, daily(spark, range(40)), ["precip"]).orderBy("date").collect()
    assert [r.precip for r in got] == [sum(range(1, 9)), sum(range(9, 17)), 0.0] and [r.forcing_valid for r in got] == [True, True, False]
    far = spark.createDataFrame([(0, DAY), (0, DAY + dt.timedelta(100))], "field long, date date")
    assert W.forward_window(far, daily(spark, [1.0] * 101), ["precip"]).orderBy("date").first().precip == W.MAX_ACCUM_DAYS


def test_join_by_date_refuses_missing_dates(spark):
    with pytest.raises(ValueError, match="2022-01-03"):
        W.join_by_date(daily(spark, [0, 0, 0]).select("field", "date"), daily(spark, [1, 2]))


def test_interpolation(spark):
    got = W.interpolated(daily(spark, [None, 1, None, None, 4, None]), ["precip"]).orderBy("date").collect()
    assert [r.precip for r in got] == [1, 1, 2, 3, 4, 4]
    with pytest.raises(ValueError, match="no value"):
        W.interpolated(daily(spark, [None, None]), ["precip"])


def test_climatology(spark):
    t = np.arange(1200)
    days = [DAY + dt.timedelta(int(i)) for i in t]
    phase = np.array([2 * np.pi * (d.timetuple().tm_yday - 1) / 365.25 for d in days])
    y = 3 + 2 * np.cos(phase) - np.sin(phase) + 0.5 * np.sin(2 * phase)
    coef = W.fit_climatology(daily(spark, y, "ta"), ["ta"]).first().coef
    assert np.allclose(coef, [3, 2, -1, 0, 0.5], atol=1e-8)
    left = W.anomalies(daily(spark, y, "ta"), ["ta"], W.fit_climatology(daily(spark, y, "ta"), ["ta"]))
    assert left.agg(F.max(F.abs("ta"))).first()[0] < 1e-8


def test_weather_build_scales_by_training_rows(spark):
    rng = np.random.default_rng(0)
    rain, ta = rng.gamma(0.3, 5, 500), rng.normal(20, 3, 500)
    both = daily(spark, rain).join(daily(spark, ta, "ta"), ["field", "date"])
    axis = both.select("field", "date")
    table, climate = W.build_weather(axis, both, ["ta"], "2023-01-01", lags=1)
    early = table.where("date < '2023-01-01'").agg(F.stddev_pop("precip"), F.stddev_pop("ta")).first()
    assert np.allclose(list(early), 1)
    late = both.withColumn("ta", F.when(F.col("date") >= "2023-01-01", F.col("ta") + 50).otherwise(F.col("ta")))
    other = W.build_weather(axis, late, ["ta"], "2023-01-01", lags=1)[1]
    assert np.allclose(climate.first().coef, other.first().coef)


def test_weather_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Date,Precip_mm,Sw_rad_mj_m2,Ta_C,VPD_kpa,extra\n1/2/2022,0,10,5,x,7\n1/13/2022,2,11,6,1,8\n2/1/2022,1,12,7,2,9\n")
    got = SF.read_weather_csv(spark, str(tmp_path / "w.csv")).collect()
    assert [r.date for r in got] == [dt.date(2022, 1, 2), dt.date(2022, 1, 13), dt.date(2022, 2, 1)]
    assert got[0].vpd is None and got[1].precip == 2 and got[2].extra == 9
    (tmp_path / "bad.csv").write_text("date,rain\nfoo,1\n")
    with pytest.raises(ValueError, match="no format"):
        SF.read_weather_csv(spark, str(tmp_path / "bad.csv"))
    axis = spark.createDataFrame([(0, DAY)], "field long, date date")
    assert SF.read_irrigation(spark, None, axis, ["mm"]).first().mm == 0


def test_cubic_alignment_against_a_loop(spark):
    rng = np.random.default_rng(0)
    src = rng.random((6, 6))
    fine, coarse = (1.0, 0, 3.0, 0, -1.0, -3.0), (2.0, 0, 0.0, 0, -2.0, 0.0)
    rows = spark.createDataFrame([(DAY, i, j, float(src[i, j])) for i in range(6) for j in range(6)], "date date, row int, col int, value double")
    grid = spark.createDataFrame([(i, j) for i in range(4) for j in range(4)], "row int, col int")
    k = lambda t: 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else (-0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0)
    for r in R.aligned(rows, grid, fine, coarse, "cubic", floor_zero=False).collect():
        sj, si = (r.col + 0.5 + 3) / 2 - 0.5, (r.row + 0.5 + 3) / 2 - 0.5
        w = [(k(abs(si - i)) * k(abs(sj - j)), src[i, j]) for i in range(6) for j in range(6)]
        assert abs(r.value - sum(a * b for a, b in w) / sum(a for a, _ in w)) < 1e-9


def test_utm(spark):
    e, n = R.utm(F.lit(75.0), F.lit(30.0), 43)
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(r.e - 500000) < 1e-3 and abs(r.n - 3318785.352) < 0.01
