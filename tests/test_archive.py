"""Calendars, masks, seasons and statistics on small made-up panels."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.functions import dates as D
from fieldcast.functions.linalg import chi2_sf
from fieldcast.operators import archive as A
from fieldcast.operators import fieldstats as S
from fieldcast.sources import frames as SF

DAY = dt.date(2024, 1, 1)


def panel(spark, values: np.ndarray, field: int = 0):
    t, n = values.shape
    rows = [(field, DAY + dt.timedelta(i), j, None if np.isnan(values[i, j]) else float(values[i, j])) for i in range(t) for j in range(n) if not np.isnan(values[i]).all()]
    return spark.createDataFrame(rows, "field long, date date, pixel long, value double")


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("a/2020_01_01/NDVI_20220131_a.tif", dt.date(2022, 1, 31)), ("x2022-02-30.tif", None), ("y2022.033.tif", dt.date(2022, 2, 2)),
        ("2022366.tif", dt.date(2023, 1, 1)), ("none.tif", None), ("20221340.tif", dt.date(221, 12, 6)),
    ],
)
def test_parse_date(spark, name, want):
    assert spark.range(1).select(D.parse_date(F.lit(name)).alias("d")).first().d == want


def test_seasons(spark):
    days = spark.sql("select explode(sequence(date'2022-01-01', date'2026-04-30')) as date, 0L as field")
    got = S.season_instances(days).collect()
    by = {(r.season, r.start_year): r for r in got}
    assert by["rabi", 2023].end == dt.date(2024, 2, 29) and by["rabi", 2023].label == "Winter (Rabi) 2023/24"
    assert by["kharif", 2022].nominal_days == 122 and all((r.end - r.start).days + 1 == r.nominal_days for r in got)
    cov = {(r.split, r.season): r.coverage for r in S.season_coverage(A.split_by_date(A.calendar(days), "2025-04-15")).collect()}
    assert abs(cov["train", "kharif"] - 3.0) < 1e-9 and abs(cov["train", "rabi"] - 3.39) < 0.01 and abs(cov["train", "zaid"] - 3.49) < 0.01


def test_gap_runs(spark):
    seen = [1, 1, 0, 0, 0, 1, 0, 1, 1, 1]
    v = np.where(np.array(seen)[:, None] == 1, 1.0, np.nan) * np.ones((10, 3))
    r = A.coverage_report(A.calendar(panel(spark, v))).first()
    assert (r.days, r.n_observed, r.gap_runs, r.longest_gap, r.longest_run, r.warn) == (10, 6, 2, 3, 3, False)


def test_duplicate_and_undated_frames(spark):
    files = spark.createDataFrame([("a_20220101.tif",), ("b_20220101.tif",), ("c.tif",)], "path string")
    with pytest.raises(ValueError, match="several files"):
        SF.frame_catalog(files)
    assert SF.frame_catalog(files, strict=False).count() == 2
    with pytest.raises(ValueError, match="none of"):
        SF.frame_catalog(files.where("path = 'c.tif'"))
    with pytest.raises(ValueError, match="no raster"):
        SF.frame_catalog(files.limit(0))


def test_common_mask_ladder(spark):
    cov = spark.createDataFrame([(0, i, 1.0 if i < 3 else 0.96) for i in range(10)], "field long, pixel long, coverage double")
    assert A.common_mask(cov, 3).count() == 3 and A.common_mask(cov, 4).count() == 10 and A.common_mask(cov, 11).count() == 3


def test_training_statistics_do_not_see_the_test_part(spark):
    v = np.random.default_rng(0).normal(size=(20, 4))
    w = v.copy()
    w[15:] += 100
    scale = lambda x: A.train_scale(x, A.split_by_date(A.calendar(x), "2024-01-16")).first()
    a, b = scale(panel(spark, v)), scale(panel(spark, w))
    assert np.allclose([a.mean, a.std], [b.mean, b.std], atol=1e-12) and abs(a.std - v[:15].std()) < 1e-12


def test_field_statistics(spark):
    v = np.random.default_rng(1).normal(0.5, 0.1, (40, 5))
    v[:, 4] -= v[:, 4].mean()
    v[2:, 3] = np.nan
    got = {r.pixel: r for r in S.field_stats(panel(spark, v), ["pixel"], min_level=1e-3).collect()}
    assert abs(got[0].variance - v[:, 0].var(ddof=1)) < 1e-12 and abs(got[0].iqr - np.subtract(*np.percentile(v[:, 0], [75, 25]))) < 1e-12
    assert got[3].mean is None and got[4].cv is None and got[4].mean is not None


def test_chi2():
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9 and abs(chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9 and chi2_sf(0, 3) == 1


def test_fraction_split_rounds_half_to_even(spark):
    cal = A.calendar(panel(spark, np.ones((10, 1))))
    assert A.split_by_fraction(cal, 0.85).where("split = 'train'").count() == 8  # 8.5
    assert A.split_by_fraction(cal, 1.0).where("split = 'train'").count() == 9
