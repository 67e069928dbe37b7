"""Empirical modes and their number, against NumPy on whole matrices."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.operators import modes as M

DAY = dt.date(2020, 1, 1)


def mosaic(n_days: int = 90, size: int = 9, r: int = 4, parcels: int = 6, noise: float = 0.02, seed: int = 0):
    """Smooth basis and parcels whose levels a smooth basis cannot express."""
    rng = np.random.default_rng(seed)
    x = np.linspace(-1, 1, size)
    gx, gy = np.meshgrid(x, x)
    phi = np.stack([np.exp(-((gx - a) ** 2 + (gy - b) ** 2)) for a, b in rng.uniform(-1, 1, (r, 2))], -1).reshape(-1, r)
    parcel = rng.integers(0, parcels, size * size)
    levels = np.cumsum(0.3 * rng.standard_normal((n_days, parcels)), 0)
    y = rng.standard_normal((n_days, r)) @ phi.T + levels[:, parcel] + noise * rng.standard_normal((n_days, size * size)) + 0.5
    return phi, y


def frames_of(spark, fields: dict, drop=()):
    rows = [(f, DAY + dt.timedelta(t), p, float(y[t, p])) for f, (phi, y) in fields.items() for t in range(len(y)) for p in range(len(phi)) if (f, t, p) not in drop]
    pixels = spark.createDataFrame(rows, "field string, date date, pixel long, value double").repartition(4)
    basis = spark.createDataFrame([(f, p, phi[p].tolist(), 0.0) for f, (phi, _) in fields.items() for p in range(len(phi))], "field string, pixel long, phi array<double>, offset double")
    return pixels, basis


def shaped(phi, left, lam, q):
    _, s, vt = np.linalg.svd(left, full_matrices=False)
    d = vt[:q].T - phi @ np.linalg.solve(lam, phi.T @ vt[:q].T)
    m, _ = np.linalg.qr(d)
    return m * np.linalg.norm(phi) / max(np.linalg.norm(m), 1e-30), s


def plain(phi, y, most, ridge, holdout=0.2):
    """Errors by number of modes, and the basis of all days."""
    cut = int(np.clip(round(len(y) * (1 - holdout)), 2, len(y) - 2))
    lam = phi.T @ phi + ridge * np.eye(phi.shape[1])

    def leftover(part, offset):
        a = part - offset
        return a - np.linalg.solve(lam, phi.T @ a.T).T @ phi.T

    off, scores = y[:cut].mean(0), {}
    for q in sorted({min(c, most) for c in M.COUNTS if c <= most} | {most}):
        b = phi if q == 0 else np.hstack([phi, shaped(phi, leftover(y[:cut], off), lam, q)[0]])
        trip = lambda part: part - off - (b @ np.linalg.solve(b.T @ b + ridge * np.eye(b.shape[1]), b.T @ (part - off).T)).T  # noqa: B023, E731
        scores[q] = (np.sqrt((trip(y[:cut]) ** 2).mean()), np.sqrt((trip(y[cut:]) ** 2).mean()), (trip(y[cut:]) ** 2).mean(0))
    best = min(scores, key=lambda q: (scores[q][1], q))
    modes, s = shaped(phi, leftover(y, y.mean(0)), lam, most)
    return scores, best, leftover(y, y.mean(0)), lam, s


@pytest.mark.parametrize(("cells", "spare"), [(1 << 20, M.SPARE), (700, 100)])
def test_modes_and_their_number(spark, monkeypatch, cells, spare):
    """With as many directions as days the iteration is exact; else modes in the noise, all alike in size, are not quite reached."""
    monkeypatch.setattr(M, "CELLS", cells)  # 700: many blocks a field
    monkeypatch.setattr(M, "SPARE", spare)
    exact = spare == 100
    fields = {"a": mosaic(), "b": mosaic(40, 6, 3, 4, 0.1, 3)}
    pixels, basis = frames_of(spark, fields)
    train = pixels.select("field", "date").distinct()
    got, report = M.augmented_basis(pixels, basis, train, most=12)
    rows = {}
    for r in report.collect():
        rows.setdefault(r.field, {})[r.q] = r
    for f, (phi, y) in fields.items():
        scores, best, left, lam, _ = plain(phi, y, 12, 1e-2)
        assert rows[f].keys() == scores.keys()
        for q, (fit, held, _) in scores.items():
            assert np.allclose([rows[f][q].rmse_fit, rows[f][q].rmse_holdout], [fit, held], rtol=1e-6 if exact else 5e-3)
        if not exact:
            best = next(q for q, r in rows[f].items() if r.chosen)
            assert scores[best][1] <= 1.01 * min(x[1] for x in scores.values())
        assert [q for q, r in rows[f].items() if r.chosen] == [best] and best > 0
        assert rows[f][best].binding == (best == 12) and rows[f][0].explained == 0
        own = {r.pixel: r for r in got.where(F.col("field") == f).collect()}
        made = np.array([own[p].phi for p in range(len(phi))])
        want, _ = shaped(phi, left, lam, best)
        k = phi.shape[1]
        assert np.allclose(made[:, :k], phi) and np.allclose([own[p].offset for p in range(len(phi))], y.mean(0))
        # modes have signs of their own
        sign = np.sign((made[:, k:] * want).sum(0))
        assert np.allclose(made[:, k:], want * sign, atol=1e-6) if exact else np.allclose(made[:, k : k + 3], (want * sign)[:, :3], atol=0.02)
        assert np.abs(made[:, k:].T @ phi).max() < 0.05 * np.abs(phi.T @ phi).max()
        assert np.isclose(np.linalg.norm(made[:, k:]), np.linalg.norm(phi))
        assert np.allclose([own[p].variance for p in range(len(phi))], scores[best][2], rtol=1e-6 if exact else 0.1)


def test_energy_rule_and_options(spark):
    fields = {"a": mosaic(60, 7, 3, 4, 0.05, 5)}
    pixels, basis = frames_of(spark, fields)
    train = pixels.select("field", "date").distinct()
    phi, y = fields["a"]
    for energy in (0.5, 0.9):
        _, _, _, _, s = plain(phi, y, 10, 1e-2)
        want = int(min(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), energy) + 1, 10))
        got, report = M.augmented_basis(pixels, basis, train, most=10, select="energy", energy=energy)
        assert len(got.first().phi) == 3 + want and [r.q for r in report.where("chosen").collect()] == [want]
    none, report = M.augmented_basis(pixels, basis, train, most=0)
    assert len(none.first().phi) == 3 and report.count() == 1
    flat, _ = M.augmented_basis(pixels, basis, train, most=4, climatology=False)
    assert flat.where("offset <> 0").count() == 0
    with pytest.raises(ValueError, match="select"):
        M.augmented_basis(pixels, basis, train, select="best")


def test_nothing_comes_from_other_days(spark):
    fields = {"a": mosaic(50, 6, 3, 4, 0.05, 7)}
    phi, y = fields["a"]
    pixels, basis = frames_of(spark, fields)
    early = pixels.select("field", "date").distinct().where(F.col("date") < DAY + dt.timedelta(30))
    later = pixels.withColumn("value", F.when(F.col("date") >= DAY + dt.timedelta(30), 99.0).otherwise(F.col("value")))
    one, two = ({r.pixel: r for r in M.augmented_basis(p, basis, early, most=6)[0].collect()} for p in (pixels, later))
    assert all(np.allclose(one[p].phi, two[p].phi) and one[p].offset == two[p].offset and np.isclose(one[p].variance, two[p].variance) for p in one)


def test_cells_without_a_value(spark):
    """They count as the pixel's mean; a pixel without any stays with its basis and offset 0."""
    fields = {"a": mosaic(40, 5, 2, 3, 0.05, 2)}
    drop = {("a", t, 3) for t in range(40)} | {("a", 7, 4), ("a", 8, 4)}
    pixels, basis = frames_of(spark, fields, drop)
    got, _ = M.augmented_basis(pixels, basis, pixels.select("field", "date").distinct(), most=4)
    own = {r.pixel: r for r in got.collect()}
    phi, y = fields["a"]
    assert len(own) == 25 and own[3].offset == 0 and np.isclose(own[4].offset, np.delete(y[:, 4], [7, 8]).mean())
