"""Alignment by field and across projections, sizes of grids, distinct picks, weather files, sealed stages."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.operators import raster as R
from fieldcast.sources import frames, stages

DAY = dt.date(2021, 3, 1)


@pytest.mark.parametrize("how", ["nearest", "bilinear", "cubic", "average"])
def test_fields_on_one_date_do_not_mix(spark, how):
    rows = [(f, DAY, i, j, v) for f, v in (("a", 0.0), ("b", 10.0)) for i in range(6) for j in range(6)]
    source = spark.createDataFrame(rows, "field string, date date, row int, col int, value double")
    grid = spark.createDataFrame([(f, i, j) for f in "ab" for i in range(4) for j in range(4)], "field string, row int, col int")
    to, affine = (2.0, 0, 0.0, 0, -2.0, 0.0), (1.5, 0, 0.0, 0, -1.5, 0.0)
    for g in (grid, grid.select("row", "col").distinct()):
        got = R.aligned(source, g, to, affine, how).collect()
        assert len(got) == 32 and all(math.isclose(r.value, {"a": 0.0, "b": 10.0}[r.field], abs_tol=1e-12) for r in got)


def test_projection_back_and_forth(spark):
    rows = [(lon, lat) for lon in np.linspace(72.1, 77.9, 13) for lat in np.linspace(-79, 79, 17)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "lon double, lat double")
    for north in (True, False):
        e, n = R.utm(F.col("lon"), F.col("lat"), 43, north)
        lon, lat = R.from_utm(F.col("e"), F.col("n"), 43, north)
        off = df.withColumns({"e": e, "n": n}).withColumns({"lon2": lon, "lat2": lat}).agg(F.max(F.abs(F.col("lon") - F.col("lon2"))).alias("a"), F.max(F.abs(F.col("lat") - F.col("lat2"))).alias("b")).first()
        assert off.a < 1e-7 and off.b < 1e-7


def forward(lon: float, lat: float) -> tuple[float, float]:
    """Transverse Mercator of zone 43 by Snyder's series in the meridian arc, another way than the library's."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    phi, lam = math.radians(lat), math.radians(lon - 75)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - 35 * e2**3 / 3072 * math.sin(6 * phi))
    n, t, c, x = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.tan(phi) ** 2, e2 / (1 - e2) * math.cos(phi) ** 2, lam * math.cos(phi)
    east = k0 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * e2 / (1 - e2)) * x**5 / 120) + 500000
    north = k0 * (m + n * math.tan(phi) * (x**2 / 2 + (5 - t + 9 * c + 4 * c**2) * x**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * e2 / (1 - e2)) * x**6 / 720))
    return east, north


def test_alignment_across_projections(spark):
    """A grid in degrees on a projected one: each projected centre, taken to degrees by search over the forward series, sees the
    cells around it."""
    rng = np.random.default_rng(2)
    src = rng.random((12, 12))
    degrees, metres = (0.001, 0.0, 74.99, 0.0, -0.001, 30.01), (60.0, 0.0, 499500.0, 0.0, -60.0, 3319300.0)
    source = spark.createDataFrame([("a", DAY, i, j, float(src[i, j])) for i in range(12) for j in range(12)], "field string, date date, row int, col int, value double")
    grid = spark.createDataFrame([("a", i, j) for i in range(5) for j in range(5)], "field string, row int, col int")
    got = {(r.row, r.col): r.value for r in R.aligned(source, grid, metres, degrees, "bilinear", project=lambda x, y: R.from_utm(x, y, 43)).collect()}
    assert len(got) == 25
    for (i, j), value in got.items():
        want = np.array([metres[2] + (j + 0.5) * 60, metres[5] - (i + 0.5) * 60])
        at = np.array([75.0, 30.0])
        for _ in range(12):  # Newton's steps with differences
            now = np.array(forward(*at))
            jac = np.column_stack([(np.array(forward(*(at + d))) - now) / 1e-6 for d in (np.array([1e-6, 0]), np.array([0, 1e-6]))])
            at = at + np.linalg.solve(jac, want - now)
        sj, si = (at[0] - degrees[2]) / 0.001 - 0.5, (at[1] - degrees[5]) / -0.001 - 0.5
        a, b = math.floor(si), math.floor(sj)
        w = [((1 - abs(si - p)) * (1 - abs(sj - q)), src[p, q]) for p in (a, a + 1) for q in (b, b + 1)]
        assert abs(value - sum(x * y for x, y in w) / sum(x for x, _ in w)) < 1e-5
    # and the other way, as means of the cells whose centres fall in
    back = R.aligned(source, grid, metres, degrees, "average", back=lambda x, y: R.utm(x, y, 43)).collect()
    cells: dict = {}
    for p in range(12):
        for q in range(12):
            e, n = forward(74.99 + (q + 0.5) * 0.001, 30.01 - (p + 0.5) * 0.001)
            cells.setdefault((math.floor((n - metres[5]) / -60), math.floor((e - metres[2]) / 60)), []).append(src[p, q])
    assert back and all(abs(r.value - np.mean(cells[r.row, r.col])) < 1e-9 for r in back)
    assert {(r.row, r.col) for r in back} == {k for k in cells if 0 <= k[0] < 5 and 0 <= k[1] < 5}


def test_sizes_come_from_the_grid(spark):
    rows = [(f, DAY, i, j, float(i * w + j)) for f, h, w in (("tall", 20, 5), ("flat", 4, 9)) for i in range(h) for j in range(w)]
    pixels = spark.createDataFrame(rows, "field string, date date, row int, col int, value double").withColumn("pixel", F.col("row") * 100 + F.col("col"))
    got = R.thinned(pixels, 25)
    assert {r.field: (r.h, r.w) for r in got.groupBy("field").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).collect()} == {"tall": (10, 2), "flat": (3, 8)}
    z = {r.field: r.n for r in R.zones(pixels, 6).groupBy("field").agg(F.count_distinct("zone").alias("n")).collect()}
    assert z == {"tall": 6, "flat": 6}
    sizes = R.zones(pixels, 6).where("field = 'tall'").groupBy("zone").count().collect()
    assert max(r["count"] for r in sizes) <= 2 * min(r["count"] for r in sizes)


def test_distinct_picks(spark):
    rng = np.random.default_rng(6)
    grid = [(f, i, float(x), float(y)) for f, n in (("a", 40), ("b", 3)) for i, (x, y) in enumerate(rng.random((n, 2)).round(1))]
    points = [(f, k, float(x), float(y)) for f in "ab" for k, (x, y) in enumerate(rng.random((8, 2)).round(1))]
    points += [("a", 8 + i, 0.5, 0.5) for i in range(5)]
    got = {(r.field, r.k): r.pixel for r in R.distinct_pixels(spark.createDataFrame(grid, "field string, pixel long, x double, y double"), spark.createDataFrame(points, "field string, k long, cx double, cy double")).collect()}
    want, taken = {}, set()
    for f, k, cx, cy in sorted(points):
        free = [((x - cx) ** 2 + (y - cy) ** 2, i) for g, i, x, y in grid if g == f and (f, i) not in taken]
        if free:
            want[f, k] = min(free)[1]
            taken.add((f, want[f, k]))
    assert got == want and len(want) == 16


def test_pixel_metres(spark):
    r = lambda *a: spark.range(1).select(R.pixel_metres(*[F.lit(x) for x in a]).alias("m")).first().m
    phi = math.radians(30.0)
    lat, lon = 111132.92 - 559.82 * math.cos(2 * phi), 111412.84 * math.cos(phi) - 93.5 * math.cos(3 * phi)
    assert math.isclose(r(0.001, -0.003, True, 30.0), math.sqrt(0.001 * lon * 0.003 * lat)) and r(-20.0, 50.0, False, 30.0) == 20.0
    assert r(0.0, 0.0, True, 30.0) == r(0.0, 10.0, False, 30.0) == 30.0


def test_weather_files(spark, tmp_path):
    """Day before month with dashes; the usual provider's names; of two names of a channel the first in the list."""
    (tmp_path / "a.csv").write_text("time,precipitation_sum,rain,shortwave_radiation_sum,temperature_2m_mean,temperature_2m_max,vapour_pressure_deficit_max,Other\n05-04-2023,1,9,2,3,4,5,6\n31-12-2023,0,9,,x,4,5,6\n")
    got = frames.read_weather_csv(spark, str(tmp_path / "a.csv")).orderBy("date").collect()
    assert [r.date for r in got] == [dt.date(2023, 4, 5), dt.date(2023, 12, 31)]
    assert (got[0].precip, got[0].rs, got[0].ta, got[0].ta_max, got[0].vpd_max, got[0].rain, got[0].Other) == (1, 2, 3, 4, 5, 9, 6)
    assert got[1].rs is None and got[1].ta is None
    assert frames.resolve_columns(["Sw_rad_mj_m2", "VPD_kpa", "Ta_C", "P", "Precip_mm", "Date"]) == {"Sw_rad_mj_m2": "rs", "VPD_kpa": "vpd", "Ta_C": "ta", "Precip_mm": "precip", "Date": "date"}


def test_sealed_stages(spark, tmp_path):
    run, calls = str(tmp_path / "run"), []

    def make(n: int, fail: bool = False):
        def rows():
            calls.append(n)
            df = spark.range(n)
            return df.select(F.raise_error(F.lit("broken")).cast("long").alias("id")) if fail else df

        return rows

    read = lambda *a: sorted(r.id for r in stages.stage(spark, run, "s", *a).collect())
    assert read(make(3), "one") == read(make(4), "one") == [0, 1, 2] and calls == [3]
    assert read(make(4), "two") == [0, 1, 2, 3] and calls == [3, 4]  # other inputs: made again
    with pytest.raises(Exception, match="broken"):
        stages.stage(spark, run, "s", make(5, True), "three")
    assert read(make(2), "two") == [0, 1]  # what broke off is not taken for the table of the inputs before
    spark.range(5).write.parquet(f"{run}/t")  # a folder without a seal is not a finished stage
    assert stages.stage(spark, run, "t", make(1)).count() == 1
    spark.range(3).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.read.parquet(f"{tmp_path}/in")
    first = stages.inputs_digest(source(), k=4)
    assert first == stages.inputs_digest(source(), k=4) != stages.inputs_digest(source(), k=5)
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert stages.inputs_digest(source(), k=4) != first
    kept = stages.stored(spark.range(4), "gone")
    assert kept.count() == 4 and stages.drop_stored(spark) >= 1 and stages.drop_stored(spark) == 0
