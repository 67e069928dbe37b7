"""Forecasts for requested days, memory orders, windowed similarity, and the sources and sinks."""

from __future__ import annotations

import datetime as dt
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.functions.dates import season_label
from fieldcast.operators import dynamics as Y
from fieldcast.operators import filtering as K
from fieldcast.operators import operational as O
from fieldcast.operators import scoring as S
from fieldcast.operators import state as X
from fieldcast.sources import frames, sinks, stages

DAY = dt.date(2020, 1, 1)
R, SIZE, T = 2, 16, 90


@pytest.fixture(scope="module")
def archive(spark):
    """Two fields of 4 x 4 pixels with a two-component state, without frames on a few days."""
    rng = np.random.default_rng(3)
    phi = rng.standard_normal((SIZE, R))
    rows, w = [], {}
    for field in ("a", "b"):
        z = [rng.standard_normal(R), rng.standard_normal(R)]
        for _ in range(T - 2):
            z.append(0.6 * z[-1] + 0.2 * z[-2] + 0.3 * rng.standard_normal(R))
        w[field] = np.array(z)
        rows += [(field, DAY + dt.timedelta(t), p, float(phi[p] @ z[t] + 0.01 * rng.standard_normal())) for t in range(T) for p in range(SIZE) if t not in (20, 21, 50)]
    pixels = spark.createDataFrame(rows, "field string, date date, pixel long, value double")
    basis = spark.createDataFrame([(f, p, phi[p].tolist(), 0.0) for f in w for p in range(SIZE)], "field string, pixel long, phi array<double>, offset double")
    return pixels, basis, phi


def models_of(pixels, basis):
    from fieldcast.operators.archive import calendar

    w = X.on_calendar(X.solve_states(pixels, basis, 0.1), calendar(pixels), R)
    return w, Y.fit_table(Y.delay_line(w, 2), mu=0.1).withColumns({"r": F.lit(0.1), "rho": F.lit(1.0)})


def test_states_agree_by_date_and_by_mask(archive):
    pixels, basis, phi = archive
    some = pixels.where("pixel < 12 or date > '2020-02-01'")
    one, other = ({(r.field, r.date): r for r in f(some, basis, 0.1).collect()} for f in (lambda p, b, n: X.solve_states(p, b, n, True), lambda p, b, n: X._by_mask(p, b, n, True)))
    assert one.keys() == other.keys() and len(one) == 2 * (T - 3)
    for k, r in one.items():
        assert np.allclose(r.w, other[k].w) and np.allclose(r.cov, other[k].cov) and math.isclose(r.r2, other[k].r2) and r.n_valid == other[k].n_valid


def test_operational_forecast_is_the_rolling_one(spark, archive):
    """A request's forecast equals that of a filter over the same window; bad requests are refused with a reason."""
    pixels, basis, _ = archive
    w, models = models_of(pixels, basis)
    ask = [("a", DAY + dt.timedelta(80)), ("b", DAY + dt.timedelta(70)), ("a", DAY + dt.timedelta(22)), ("a", DAY + dt.timedelta(50)), ("b", DAY + dt.timedelta(300)), ("c", DAY), ("a", DAY + dt.timedelta(T - 1))]
    requests = spark.createDataFrame(ask, "field string, origin date")
    reasons = {(r.field, (r.origin - DAY).days): (r.reason, r.scoreable) for r in O.checked_requests(requests, w.select("field", "date", "t", "observed"), 2, 3).collect()}
    assert reasons == {
        ("a", 80): (None, True), ("b", 70): (None, True), ("a", 22): ("fewer than 2 observed days behind", False), ("a", 50): ("not observed", False),
        ("b", 300): ("not observed", False), ("c", 0): ("not on the calendar", False), ("a", T - 1): (None, False),
    }
    got = {(r.field, (r.origin - DAY).days, r.lead): r.w for r in O.operational_forecasts(requests, pixels, basis, models, 0.1, 2, 3, context=20).collect()}
    assert {k[:2] for k in got} == {("a", 80), ("b", 70)}
    for field, t in (("a", 80), ("b", 70)):
        window = w.where(f"field = '{field}' and t between {t - 19} and {t + 3}").select("field", F.col("t").cast("long").alias("t"), "observed", "w")
        want = {r.lead: r.w for r in K.rolling_forecasts(window, models, {t}, 3, K.VARIANTS[:1]).collect()}
        assert all(np.allclose(got[field, t, h], want[h]) for h in (1, 2, 3))
    with_frames = {(r.field, r.lead): r.w for r in O.operational_forecasts(requests.limit(2), pixels, basis, models, 0.1, 2, 3, 20, assimilate=True).collect()}
    assert np.allclose(with_frames["a", 1], got["a", 80, 1]) and not np.allclose(with_frames["a", 2], got["a", 80, 2])


def test_models_as_rows_filter_alike(archive):
    pixels, basis, _ = archive
    w, models = models_of(pixels, basis)
    rows = w.select("field", F.col("t").cast("long").alias("t"), "observed", "w")
    held = {f: {"A": Y.limit_radius(a), "B": b, "Q": q, "R": 0.1 * np.eye(R)} for f, (a, b, q) in Y.fit_operator(Y.delay_line(w, 2), mu=0.1).items()}
    one, other = ({(r.field, r.t): r.w for r in K.filtered(rows, m).collect()} for m in (models, held))
    assert one.keys() == other.keys() and all(np.allclose(one[k], other[k]) for k in one)


def test_memory_orders(spark, archive):
    pixels, basis, _ = archive
    w = models_of(pixels, basis)[0].withColumn("split", F.when(F.col("t") < 60, "train").otherwise("test"))
    forecasts, models = O.order_forecasts(w, [1, 2, 3], 2, 0.1, 0.1)
    starts = {(r.field, r.t) for r in O.shared_origins(w, 3, 2).collect()}
    assert starts == {(f, t) for f in "ab" for t in range(62, T - 2)}
    assert all({(r.field, r.origin) for r in forecasts.where(F.col("order") == o).collect()} == starts for o in (1, 3))
    facts = {(r.field, r.order): r for r in O.model_facts(models, 2, ["field", "order"]).collect()}
    assert [facts["a", o].n_parameters for o in (1, 2, 3)] == [4, 8, 12] and all(0 < r.rho < 1.2 and 0 <= r.last_ratio <= 1 for r in facts.values())
    scores = {(r.order, r.lead): r for r in O.ablation_scores(forecasts, basis, pixels).collect()}
    latent = {(r.order, r.lead): r.latent_rmse for r in O.latent_scores(forecasts, w, ["order"]).collect()}
    assert len(scores) == len(latent) == 6 and all(s.n_origins == len(starts) for s in scores.values())
    truth = {(r.field, r.t): np.array(r.w) for r in w.where("observed").collect()}
    want = [((np.array(r.w) - truth[r.field, r.origin + 1]) ** 2).mean() for r in forecasts.where("`order` = 2 and lead = 1").collect()]
    assert math.isclose(latent[2, 1], math.sqrt(np.mean(want)))


def test_windowed_ssim(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((2, 9, 10))
    rows = [(0, r, c, float(a[r, c]), float(b[r, c])) for r in range(9) for c in range(10)] + [(1, r, c, float(a[r, c]), float(a[r, c])) for r in range(3) for c in range(3)]
    got = {r.k: r.ssim for r in S.windowed_ssim(spark.createDataFrame(rows, "k int, row int, col int, pred double, value double"), ["k"]).collect()}
    span, each = b.max() - b.min() + 1e-8, []
    for r in range(3):
        for c in range(4):
            x, y = a[r : r + 7, c : c + 7].ravel(), b[r : r + 7, c : c + 7].ravel()
            cov = np.cov(x, y)
            c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
            each.append((2 * x.mean() * y.mean() + c1) * (2 * cov[0, 1] + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    assert math.isclose(got[0], np.mean(each), rel_tol=1e-9) and math.isclose(got[1], 1.0, abs_tol=1e-9)


def test_interval_and_season_names(spark):
    assert abs(S.interval_z(0.95) - 1.959964) < 1e-6
    df = spark.createDataFrame([("kharif", 2023), ("zaid", 2024), ("rabi", 2023)], "s string, y int")
    assert [r.l for r in df.select(season_label(F.col("s"), F.col("y")).alias("l")).collect()] == ["Summer (Kharif) 2023", "Spring (Zaid) 2024", "Winter (Rabi) 2023/24"]


def test_radius_keeps_the_shape():
    rng = np.random.default_rng(0)
    blocks = [rng.standard_normal((3, 3)) for _ in range(3)]
    got = Y.limit_radius(blocks, 0.9)
    assert np.allclose(got[0] / blocks[0], got[2] / blocks[2]) and abs(np.abs(np.linalg.eigvals(Y.companion(got))).max() - 0.9) < 1e-6


def test_two_stage_falls_back_by_field(spark):
    rng = np.random.default_rng(2)
    rows = [(f, i, rng.standard_normal(2).tolist(), rng.standard_normal(2).tolist(), [float(f == "wet" or i % 2)]) for f in ("dry", "wet") for i in range(80)]
    d = spark.createDataFrame(rows, "field string, t int, x array<double>, y array<double>, u array<double>")
    got = Y.two_stage(d, F.col("u")[0] == 0)
    calm = Y.fit_operator(d.where("field = 'dry' and u[0] = 0"))["dry"][0]
    assert np.allclose(got["dry"][0], calm) and np.allclose(got["wet"][0], Y.fit_operator(d.where("field = 'wet'"))["wet"][0])


def test_sources(spark, tmp_path):
    for name in ("F_20240101.tif", "F_20240109.tiff", "note.txt", "undated.tif"):
        (tmp_path / name).write_bytes(b"\x01\x02")
    listed = {os.path.basename(r[0]) for r in frames.list_files(spark, str(tmp_path)).collect()}
    assert {"F_20240101.tif", "F_20240109.tiff"} <= listed and "note.txt" not in listed
    axis = spark.createDataFrame([("a", DAY), ("a", DAY + dt.timedelta(8))], "field string, date date")
    none = frames.read_irrigation(spark, str(tmp_path / "none.csv"), axis, ["mm"])
    assert [r.mm for r in none.collect()] == [0.0, 0.0]


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([("recursive", 1, 0.5)], "variant string, lead int, rmse double")
    sinks.write_report(report, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).collect() == report.collect()
    sinks.write_report(report, str(tmp_path / "j"), as_json=True)
    parts = [p for p in os.listdir(tmp_path / "j") if p.startswith("part-")]
    assert len(parts) == 1 and json.loads((tmp_path / "j" / parts[0]).read_text().splitlines()[0])
    origin = DAY + dt.timedelta(3)
    f = spark.createDataFrame([("a", "recursive", origin, 1, p, float(p)) for p in range(3)], "field string, variant string, origin date, lead int, pixel long, pred double")
    truth = spark.createDataFrame([("a", origin + dt.timedelta(1), 0, 12.0)], "field string, date date, pixel long, value double")
    std = spark.createDataFrame([("a", origin, 1, 0, 0.5)], "field string, origin date, lead int, pixel long, band double")
    maps = sinks.forecast_maps(f, truth, spark.createDataFrame([("a", 10.0, 2.0)], "field string, mean double, std double"), std, "NDVI")
    sinks.write_maps(sinks.with_nodata(maps), str(tmp_path / "maps"))
    got = {r.pixel: r for r in spark.read.parquet(str(tmp_path / "maps")).collect()}
    assert (got[0].forecast, got[0].std, got[0].error) == (10.0, 0.5, -2.0) and got[2].error == sinks.NODATA and got[1].tags["target"] == str(origin + dt.timedelta(1))


def test_stages_go_on(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    assert stages.stage(spark, str(tmp_path), "one", make).count() == stages.stage(spark, str(tmp_path), "one", make).count() == 3 and len(calls) == 1
    assert stages.stored(spark.range(5), "x").count() == 5

