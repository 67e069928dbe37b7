"""Structured kernels, rails, emission and excitation on rows, against NumPy on the trajectories themselves."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.functions.linalg import companion, spectral_radius
from fieldcast.operators import dynamics as Y
from fieldcast.operators import horizons as H
from fieldcast.operators import kernels as R


def modal_system(n: int, lags: int = 3, noise: float = 0.05, seed: int = 0, bend: float = 0.0):
    """Four components, a rotation and two real modes, memory 0.25^j in each mode, two inputs that are mostly zero."""
    rng = np.random.default_rng(seed)
    p = rng.standard_normal((4, 4)) + 2 * np.eye(4)
    d = np.zeros((4, 4))
    d[:2, :2] = 0.6 * np.array([[math.cos(0.5), math.sin(0.5)], [-math.sin(0.5), math.cos(0.5)]])
    d[2, 2], d[3, 3] = 0.5, 0.3
    a = [p @ d @ np.linalg.inv(p) * 0.25**j for j in range(lags)]
    b, u = rng.standard_normal((4, 2)), rng.gamma(1.0, 1.0, (n, 2)) * (rng.random((n, 1)) < 0.3)
    w = [rng.standard_normal(4) for _ in range(lags)]
    for t in range(lags - 1, n - 1):
        w.append(sum(a[j] @ w[t - j] for j in range(lags)) + b @ u[t] + noise * rng.standard_normal(4))
    return a, b, u, np.array(w)


def weights_of(spark, w, u, seen=None, field="a"):
    seen = np.ones(len(w), bool) if seen is None else seen
    return spark.createDataFrame([(field, t, bool(seen[t]), w[t].tolist(), u[t].tolist()) for t in range(len(w))], "field string, t long, observed boolean, w array<double>, u array<double>")


def stacked(w, u, lags):
    ts = range(lags - 1, len(w) - 1)
    return np.array([np.concatenate([w[t - j] for j in range(lags)]) for t in ts]), np.array([u[t] for t in ts]), np.array([w[t + 1] for t in ts])


def solved(x, y, mu):
    return np.linalg.solve(x.conj().T @ x + mu * np.eye(x.shape[1]), x.conj().T @ y)


def plain_kernel(x, y, k, lags, structure, mu, rank, increment):
    """The kernel from the rows themselves, not from sums."""
    y = y - x[:, :k] if increment else y
    if structure == "full":
        g = solved(x, y, mu).T
        out = [g[:, j * k : (j + 1) * k] for j in range(lags)]
    else:
        first = solved(x[:, :k], y, mu).T
        if structure == "reduced":
            g = solved(x[:, k:], y - x[:, :k] @ first.T, mu).T
            s, d, vt = np.linalg.svd(g, full_matrices=False)
            low = (s[:, :rank] * d[:rank]) @ vt[:rank]
            out = [first, *[low[:, j * k : (j + 1) * k] for j in range(lags - 1)]]
        else:
            values, v = np.linalg.eig(first)
            inv = np.linalg.inv(v)
            z, zy = [x[:, j * k : (j + 1) * k] @ inv.T for j in range(lags)], y @ inv.T
            out = [np.zeros((k, k), complex) for _ in range(lags)]
            for m in range(k):
                own = np.column_stack([c[:, m] for c in z])
                alpha = np.linalg.solve(own.conj().T @ own * _unit(v, m) + mu * np.eye(lags), own.conj().T @ zy[:, m] * _unit(v, m))
                for j in range(lags):
                    out[j] += alpha[j] * np.outer(v[:, m], inv[m])
            out = [c.real for c in out]
    out[0] = out[0] + np.eye(k) * increment
    return out


def _unit(v, m):
    """eig scales complex vectors to length one, as the real form does; its coordinate of a pair is twice as large."""
    return 4.0 if abs(v[:, m].imag).max() > 1e-12 else 1.0


@pytest.mark.parametrize("structure", ["full", "modal", "reduced"])
@pytest.mark.parametrize("increment", [False, True])
def test_kernels_from_moments(spark, structure, increment):
    _, _, u, w = modal_system(400)
    design = Y.delay_line(weights_of(spark, w, u), 3, 1, "u")
    x, us, y = stacked(w, u, 3)
    r = R.fit_kernels(design, structure, 0.01, 2, increment).first()
    a, b, q = Y.unpacked(r)
    assert np.allclose(a, plain_kernel(x, y, 4, 3, structure, 0.01, 2, increment), atol=1e-7)
    rest = y - x @ np.hstack(a).T
    assert np.allclose(b, solved(us, rest, 0.01).T, atol=1e-8)
    rest = rest - us @ b.T
    assert np.allclose(q, rest.T @ rest / (len(y) - 1), atol=1e-6) and (r.n, r.structure) == (len(y), structure)
    assert structure != "reduced" or np.linalg.matrix_rank(np.hstack(a[1:]), 1e-8) == 2


def test_kernels_recover_a_known_one(spark):
    """The modal structure finds the memory of each mode and the shared one the common profile, from quiet rows alone."""
    a, b, u, w = modal_system(6000, noise=0.3)
    design = Y.delay_line(weights_of(spark, w, u), 3, 1, "u")
    quiet = F.aggregate("u", F.lit(0.0), lambda s, x: s + F.abs(x)) <= 1e-8
    for structure, off in (("full", 0.12), ("modal", 0.25), ("shared", 0.25)):
        models = R.fit_kernels(design, structure, 1e-3, increment=structure == "full", quiet=quiet)
        r = models.first()
        got, b_got, _ = Y.unpacked(r)
        assert np.abs(np.hstack(got) - np.hstack(a)).max() < off and np.abs(b_got - b).max() < 0.15, structure
        assert r.n_quiet == int((np.abs(u[2:-1]).sum(1) <= 1e-8).sum()) < r.n
    modes = {}
    for x in R.memory_profile(R.fit_kernels(design, "modal", 1e-3, increment=False, quiet=quiet)).collect():
        modes.setdefault(x.mode, []).append(x)
    assert len(modes) == 3 and all(len(x) == 3 and 0 < x[0].half_life < 10 for x in modes.values())
    # So many lags as rows are needed to be quiet: else all rows are used.
    few = R.fit_kernels(design.where("t < 30"), "full", 1e-3, quiet=quiet).first()
    assert np.allclose(few.a, R.fit_kernels(design.where("t < 30"), "full", 1e-3).first().a)


def test_increment_in_modal_coordinates_is_the_identity(spark):
    _, _, u, w = modal_system(300)
    design = Y.delay_line(weights_of(spark, w, u), 2, 1, "u")
    r = R.fit_kernels(design, "modal", 0.1).first()
    blocks, _, _ = Y.unpacked(r)
    c = np.array(r.coefficients).reshape(-1, 2, 2)
    alpha = c[..., 0] + 1j * c[..., 1]
    roots = np.concatenate([np.roots(np.r_[1, -x]) for x in alpha])
    roots = np.concatenate([roots, *[np.roots(np.r_[1, -x]).conj() for x in alpha if np.abs(x.imag).max() > 1e-9]])
    # each mode splits into as many lifted ones as there are lags
    lifted = np.linalg.eigvals(companion(blocks))
    assert np.allclose(sorted(np.abs(roots)), sorted(np.abs(lifted)), atol=1e-8)


def test_real_modes():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a = rng.standard_normal((5, 5))
        p, modes = R.real_modes(a)
        d = np.zeros((5, 5))
        for x, size, v in modes:
            d[x : x + size, x : x + size] = R._block(v) if size == 2 else v.real
        assert np.allclose(p @ d @ np.linalg.inv(p), a) and sum(size for _, size, _ in modes) == 5


def test_bad_input(spark):
    rows = weights_of(spark, np.array([[1.0, 2.0]] * 20), np.zeros((20, 1)))
    design = Y.delay_line(rows.withColumn("w", F.when(F.col("t") == 7, F.array(F.lit(float("nan")), F.lit(0.0))).otherwise(F.col("w"))), 2, 1, "u")
    with pytest.raises(Exception, match="not finite"):
        R.fit_kernels(design, "full").collect()
    with pytest.raises(ValueError, match="structure"):
        R.fit_kernels(design, "best")


def looped_error(blocks, b, w, u, origins, horizon):
    total = []
    for t in origins:
        z = [w[t - j] for j in range(len(blocks))]
        for h in range(horizon):
            new = sum(a @ x for a, x in zip(blocks, z, strict=True)) + b @ u[t + h]
            z = [new, *z[:-1]]
            total.append(((new - w[t + h + 1]) ** 2).sum())
    return math.sqrt(np.mean(total))


def test_rails(spark):
    """The blend chosen from moments is the one that a loop over the tail's origins chooses."""
    _, _, u, w = modal_system(260, noise=0.8)
    rows, horizon = weights_of(spark, w, u), 4
    models = R.fit_kernels(Y.delay_line(rows.where("t < 120"), 2, 1, "u"), "full", 1e-3, increment=False)
    a, b, _ = Y.unpacked(models.first())
    tails = R.tail_moments(H.horizon_design(rows, 2, horizon, "u"), 0.25)
    n = 260 - 1 - horizon
    origins = [t for i, t in enumerate(range(1, 260 - horizon), 1) if i > n * 0.75]
    for cap in (None, 2.0, 1.05):
        r = R.railed(models, horizon, tails, cap=cap, radius=None).first()
        scores = {s: looped_error(Y._blended(a, s), b, w, u, origins, horizon) for s in Y.BLENDS if not s or cap is None or Y.forecast_gain(Y._blended(a, s), horizon) <= cap}
        best = min(scores, key=scores.get)
        assert r.blend == best and np.isclose(r.error, scores[best]) and np.isclose(r.error_persistence, scores[0.0]) and r.error <= r.error_persistence
        assert np.allclose(Y.unpacked(r)[0], Y._blended(a, best)) and np.isclose(r.gain, Y.forecast_gain(Y._blended(a, best), horizon))
    loud = models.withColumn("a", F.transform("a", lambda x: x * 3))
    held = R.railed(loud, horizon, cap=None, radius=0.9).first()
    assert np.isclose(held.radius, 0.9, atol=1e-9) and held.blend == 1 and held.error is None
    by_gain = R.railed(loud, horizon, cap=1.5, radius=None).first()
    assert by_gain.gain <= 1.5 + 1e-9 and by_gain.blend < 1
    few = R.railed(models, horizon, R.tail_moments(H.horizon_design(rows.where("t < 20"), 2, horizon, "u"), 0.1), cap=2.0, radius=None).first()
    assert few.gain <= 1 + 1e-9  # fewer than four origins: no gain over persistence's
    calm = R.railed(models.withColumn("a", F.transform("a", lambda x: x * 0.1)), horizon, radius=1.0).first()
    assert np.allclose(calm.a, np.array(models.first().a) * 0.1)  # what keeps within both stays as it is
    both = models.unionByName(models.withColumns({"field": F.lit("p"), "a": F.concat(F.flatten(F.array(*[F.array(*[F.lit(float(i == j)) for j in range(4)]) for i in range(4)])), F.array_repeat(F.lit(0.0), 16))}))
    assert {x.field: x.persistence for x in R.is_persistence(both).collect()} == {"a": False, "p": True}


def test_railed_models_filter_and_forecast(spark):
    from fieldcast.operators import filtering as K

    _, _, u, w = modal_system(80)
    rows = weights_of(spark, w, u)
    models = R.railed(R.fit_kernels(Y.delay_line(rows, 3, 1, "u"), "modal"), 3).withColumn("r", F.lit(0.1))
    got = {r.lead: r for r in K.rolling_forecasts(rows, models, {60}, 3, K.VARIANTS[:1]).collect()}
    a, b, _ = Y.unpacked(models.first())
    z = K.states_at(rows, models, rows.where("t = 60")).first().z
    z = np.array(z)
    for h in (1, 2, 3):
        z = companion(a) @ z
        z[:4] += b @ u[60 + h - 1]
        assert np.allclose(got[h].w, z[:4])
    assert spectral_radius(companion(a)) <= 1 + 1e-9


def test_emission_rows(spark):
    rng = np.random.default_rng(9)
    w, c = rng.standard_normal((300, 3)), rng.standard_normal((2, 3))
    y = np.column_stack([w @ c[0] + 0.3 * rng.standard_normal(300), rng.standard_normal(300)])
    df = spark.createDataFrame([(f, t, w[t].tolist(), y[t].tolist()) for f in (0, 1) for t in range(300)], "field long, t long, w array<double>, y array<double>")
    r = Y.emission_rows(df, 1e-3).where("field = 1").first()
    part, whole = solved(w[:255], y[:255], 1e-3).T, solved(w, y, 1e-3).T
    rest, tail = y - w @ whole.T, y[255:] - w[255:] @ part.T
    cov = rest.T @ rest / 299
    assert np.allclose(r.c, whole.ravel()) and np.allclose(r.s, (cov + 1e-8 * np.trace(cov) / 2 * np.eye(2)).ravel())
    assert np.allclose(r.r2, 1 - (tail**2).sum(0) / ((y[255:] - y[255:].mean(0)) ** 2).sum(0)) and r.r2[0] > 0.5 > 0.2 > r.r2[1] and r.usable
    d = np.sqrt(np.diag(cov))
    assert np.allclose(r.correlation, (cov / np.outer(d, d)).ravel(), atol=1e-6)
    assert np.isclose(Y.emission_rows(df, full=False).first().s[1], 0)
    noise = df.withColumn("y", F.array(F.sin(F.col("t") * 12.9), F.cos(F.col("t") * 7.7)))
    assert not Y.emission_rows(noise).first().usable or max(Y.emission_rows(noise).first().r2) > 0
    p = rng.standard_normal((3, 3))
    p = p @ p.T
    g = Y.information_gain(Y.emission_rows(df), spark.createDataFrame([(1, p.ravel().tolist())], "field long, cov array<double>")).first()
    s = np.reshape(r.s, (2, 2))
    after = p - p @ whole.T @ np.linalg.inv(whole @ p @ whole.T + s) @ whole @ p
    assert np.isclose(g.trace_prior, np.trace(p)) and np.isclose(g.trace_posterior, np.trace(after)) and np.isclose(g.removed, 1 - np.trace(after) / np.trace(p))


def test_excitation_and_response_maps(spark):
    rng = np.random.default_rng(1)
    x, u = rng.standard_normal((50, 3)), rng.standard_normal((50, 1))
    df = spark.createDataFrame([("a", x[i].tolist(), u[i].tolist()) for i in range(50)] + [("b", x[i].tolist(), [float(x[i] @ [1, 2, 3])]) for i in range(50)], "field string, x array<double>, u array<double>")
    got = {r.field: r for r in Y.excitation(df).collect()}
    s = np.linalg.svd(np.hstack([x, u]), compute_uv=False)
    assert got["a"].satisfied and np.isclose(got["a"].condition, s[0] / s[-1]) and (got["b"].rank, got["b"].deficiency, got["b"].satisfied) == (3, 1, False)
    b, phi = rng.standard_normal((3, 2)), rng.standard_normal((5, 3))
    models = spark.createDataFrame([("a", 3, b.ravel().tolist()), ("b", 3, [])], "field string, k int, b array<double>")
    basis = spark.createDataFrame([(f, i, phi[i].tolist()) for f in "ab" for i in range(5)], "field string, pixel long, phi array<double>")
    maps = {(r.field, r.pixel, r.channel): r.response for r in Y.response_maps(models, basis).collect()}
    assert maps.keys() == {("a", i, j) for i in range(5) for j in range(2)} and all(np.isclose(v, phi[i] @ b[:, j]) for (_, i, j), v in maps.items())
