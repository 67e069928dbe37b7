"""Subspaces as rows, lifts, bands and requested maps, against NumPy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.functions.linalg import companion
from fieldcast.operators import dynamics as Y
from fieldcast.operators import operational as O
from fieldcast.operators import subspace as B
from fieldcast.sources import sinks

DAY = dt.date(2020, 1, 1)


@pytest.fixture(scope="module")
def low(spark):
    """Two fields: eight components of true rank three, with a covariance each."""
    rng = np.random.default_rng(4)
    data = {}
    for f in ("a", "b"):
        w = rng.standard_normal((50, 3)) @ rng.standard_normal((3, 8)) + 0.01 * rng.standard_normal((50, 8)) + 2
        c = rng.standard_normal((50, 8, 8))
        data[f] = (w, c @ c.transpose(0, 2, 1))
    rows = [(f, t, w[t].tolist(), c[t].ravel().tolist()) for f, (w, c) in data.items() for t in range(50)]
    return data, spark.createDataFrame(rows, "field string, t long, w array<double>, cov array<double>")


@pytest.mark.parametrize("part", [2048, 7])
def test_projection_and_lifts(spark, low, monkeypatch, part):
    monkeypatch.setattr(B, "PART", part)
    data, rows = low
    sub = B.subspace_rows(rows, 0.99, least=2)
    subs = {r.field: (np.array(r.mean), np.array(r.axes).reshape(r.k, r.r)) for r in sub.collect()}
    got = B.projected(rows, sub, "cov")
    for f, (w, c) in data.items():
        mean, u = subs[f]
        s = np.linalg.svd(w - w.mean(0), compute_uv=False) ** 2
        assert len(u) == max(2, int(np.searchsorted(np.cumsum(s) / s.sum(), 0.99)) + 1) and np.allclose(u @ u.T, np.eye(len(u)))
        for r in got.where(F.col("field") == f).collect():
            z = u @ (w[r.t] - mean)
            assert np.allclose(r.z, z) and np.allclose(r.complement, w[r.t] - mean - z @ u) and np.allclose(r.cov_z, (u @ c[r.t] @ u.T).ravel())
    back = B.reconstructed(got.select("field", "t", "z", "complement"), sub, "complement")
    assert all(np.allclose(r.w, data[r.field][0][r.t]) for r in back.collect())
    plain = B.reconstructed(got.select("field", "t", "z"), sub).where("field = 'a' and t = 3").first()
    assert np.allclose(plain.w, subs["a"][0] + np.array(subs["a"][1]).T @ (subs["a"][1] @ (data["a"][0][3] - subs["a"][0])))
    up = B.lifted_covariances(got.select("field", "t", F.col("cov_z").alias("cov")), sub).where("field = 'b' and t = 9").first()
    u = subs["b"][1]
    assert np.allclose(up.cov, (u.T @ (u @ data["b"][1][9] @ u.T) @ u).ravel()) and np.linalg.matrix_rank(np.reshape(up.cov, (8, 8)), 1e-9) == len(u)


def test_lifted_models_keep_the_spectrum(spark, low):
    _, rows = low
    sub = B.subspace_rows(rows, 0.99, least=2)
    z = B.projected(rows, sub).select("field", "t", F.col("z").alias("w"), F.lit(True).alias("observed"))
    models = Y.fit_table(Y.delay_line(z, 2), mu=0.1)
    lifted = {r.field: Y.unpacked(r) for r in B.lifted_models(models, sub).collect()}
    for r in models.collect():
        a, _, q = Y.unpacked(r)
        b, _, p = lifted[r.field]
        small, large = (sorted(np.abs(np.linalg.eigvals(companion(x))))[::-1] for x in (a, b))
        assert np.allclose(small, large[: len(small)], atol=1e-6) and len(b[0]) == 8 and np.isclose(np.trace(p), np.trace(q))
    assert {(r.field, r.order) for r in Y.memory_sweep(z, 3).collect()} == {(f, o) for f in "ab" for o in (1, 2, 3)}


@pytest.mark.parametrize("block", [4096, 3])
def test_bands(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    rng = np.random.default_rng(5)
    phi, c = rng.standard_normal((10, 4)), rng.standard_normal((2, 4, 4))
    c = c @ c.transpose(0, 2, 1)
    basis = spark.createDataFrame([("a", p, phi[p].tolist()) for p in range(10)], "field string, pixel long, phi array<double>")
    full = spark.createDataFrame([("a", "v", h, c[h].ravel().tolist(), float(np.trace(c[h]))) for h in range(2)], "field string, variant string, lead int, cov array<double>, cov_trace double")
    got = {(r.lead, r.pixel): r.variance for r in B.bands(basis, full, ["variant", "lead"], 0.3).collect()}
    assert len(got) == 20 and all(np.isclose(v, phi[p] @ c[h] @ phi[p] + 0.3) for (h, p), v in got.items())
    flat = {(r.lead, r.pixel): r.variance for r in B.bands(basis, full, ["variant", "lead"], 0.3, cov=None).collect()}
    assert all(np.isclose(v, np.trace(c[h]) / 4 * phi[p] @ phi[p] + 0.3) for (h, p), v in flat.items())
    u = np.linalg.qr(rng.standard_normal((4, 2)))[0].T
    sub = spark.createDataFrame([("a", 4, 2, [0.0] * 4, u.ravel().tolist())], "field string, r int, k int, mean array<double>, axes array<double>")
    small = full.withColumn("cov", F.array(*[F.lit(float(x)) for x in (2.0, 0.5, 0.5, 1.0)]))
    inside = {(r.lead, r.pixel): r.variance for r in B.bands(basis, small, ["variant", "lead"], 0.3, sub).collect()}
    s = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert all(np.isclose(v, phi[p] @ u.T @ s @ u @ phi[p] + 0.3) for (_, p), v in inside.items())


def test_requested_maps(spark, tmp_path):
    rng = np.random.default_rng(6)
    phi, days = rng.standard_normal((5, 2)), 12
    values = rng.standard_normal((days, 5))
    rows = [("a", DAY + dt.timedelta(t), p, float(values[t, p])) for t in range(days) for p in range(5) if (t, p) != (2, 4)]
    pixels = spark.createDataFrame(rows, "field string, date date, pixel long, value double")
    basis = spark.createDataFrame([("a", p, phi[p].tolist(), 0.25) for p in range(5)], "field string, pixel long, phi array<double>, offset double")
    w, c = rng.standard_normal((days, 2)), np.array([[0.5, 0.1], [0.1, 0.4]])
    fc = [("a", "recursive", DAY + dt.timedelta(t), h, w[t].tolist(), (h * c).ravel().tolist()) for t in range(days) for h in (1, 2)]
    forecasts = spark.createDataFrame(fc, "field string, variant string, origin date, lead int, w array<double>, cov array<double>")
    scale = spark.createDataFrame([("a", 10.0, 2.0)], "field string, mean double, std double")
    rep = spark.createDataFrame([("a", p, 0.1 * p) for p in range(5)], "field string, pixel long, variance double")
    maps = O.requested_maps(forecasts, pixels, basis, 0.05, scale, rep, "kelvin", most=4)
    got = {((r.origin - DAY).days, r.lead, r.pixel): r for r in maps.collect()}
    assert sorted({k[0] for k in got}) == [0, 4, 7, 11] and len(got) == 4 * 2 * 5
    for (t, h, p), r in got.items():
        if p == 4:  # not valid on every frame
            assert r.forecast == r.std == r.error == sinks.NODATA
            continue
        pred = (phi[p] @ w[t] + 0.25) * 2 + 10
        assert np.isclose(r.forecast, pred) and np.isclose(r.std, np.sqrt((phi[p] @ (h * c) @ phi[p] + 0.05) * 4 + 0.1 * p))
        assert r.error == sinks.NODATA if t + h >= days else np.isclose(r.error, pred - values[t + h, p])
        assert r.tags["target"] == str(DAY + dt.timedelta(t + h)) and r.tags["units"] == "kelvin"
    sinks.write_maps(maps, str(tmp_path / "maps"))
    assert spark.read.parquet(str(tmp_path / "maps")).count() == len(got)
    assert O.requested_maps(forecasts, pixels, basis, 0.05, most=None).select("origin").distinct().count() == days
