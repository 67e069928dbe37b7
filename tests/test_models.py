"""States, memory models, filters, covariograms and whiteness against NumPy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.functions.linalg import companion
from fieldcast.operators import covariogram as C
from fieldcast.operators import dynamics as Y
from fieldcast.operators import filtering as K
from fieldcast.operators import moments as G
from fieldcast.operators import observers as O
from fieldcast.operators import state as X
from fieldcast.operators import whiteness as T
from fieldcast.sources import sinks

DAY = dt.date(2024, 1, 1)


def trajectory(n: int = 400, k: int = 3, seed: int = 0, noise: float = 0.1):
    rng = np.random.default_rng(seed)
    a = [np.diag([0.6, 0.5, 0.3])[:k, :k] + 0.05 * rng.standard_normal((k, k)), 0.2 * np.eye(k)]
    w = np.zeros((n, k))
    for t in range(2, n):
        w[t] = a[0] @ w[t - 1] + a[1] @ w[t - 2] + noise * rng.standard_normal(k)
    return a, w


def weights(spark, w, observed=None, field=0):
    seen = np.ones(len(w), bool) if observed is None else observed
    return spark.createDataFrame([(field, t, DAY + dt.timedelta(t), bool(seen[t]), [float(v) for v in w[t]]) for t in range(len(w))], "field long, t long, date date, observed boolean, w array<double>")


def test_moments(spark):
    rng = np.random.default_rng(0)
    x, y, key = rng.random((90, 3)), rng.random((90, 2)), rng.integers(0, 4, 90)
    df = spark.createDataFrame([(int(k), a.tolist(), b.tolist()) for k, a, b in zip(key, x, y)], "k int, x array<double>, y array<double>")
    for r in G.moments(df, ["k"], "x", "y").collect():
        m = key == r.k
        assert r.n == m.sum() and np.allclose(r.xx, (x[m].T @ x[m]).ravel()) and np.allclose(r.xy, (x[m].T @ y[m]).ravel()) and np.allclose(r.yy, (y[m] ** 2).sum(0))


@pytest.mark.parametrize("holes", [False, True])
def test_states_against_ridge(spark, holes):
    rng = np.random.default_rng(1)
    phi, w = rng.random((30, 4)), rng.standard_normal((6, 4))
    v = w @ phi.T + 0.01 * rng.standard_normal((6, 30)) + 2
    valid = rng.random((6, 30)) < 0.7 if holes else np.ones((6, 30), bool)
    if holes:
        valid[5] = False
        valid[5, 0] = True
    px = spark.createDataFrame([(0, DAY + dt.timedelta(t), p, float(v[t, p])) for t in range(6) for p in range(30) if valid[t, p]], "field long, date date, pixel long, value double")
    basis = spark.createDataFrame([(0, p, phi[p].tolist(), 2.0) for p in range(30)], "field long, pixel long, phi array<double>, offset double")
    got = X.solve_states(px, basis, 0.1, cov=True).orderBy("date").collect()
    for t, r in enumerate(got):
        f = phi[valid[t]]
        if len(f) < 2:
            assert r.w == [0.0] * 4 and r.cov[0] == X.NO_INFORMATION
            continue
        lam = np.linalg.inv(f.T @ f + 0.1 * np.eye(4))
        y = v[t, valid[t]] - 2
        want = lam @ f.T @ y
        assert np.allclose(r.w, want) and np.allclose(r.cov, (0.1 * lam).ravel())
        assert abs(r.r2 - (1 - ((y - f @ want) ** 2).sum() / (((y - y.mean()) ** 2).sum() + 1e-12))) < 1e-8
    states = X.solve_states(px, basis, 0.1)
    back = {(r.date, r.pixel): r.pred for r in X.decode(states, basis, ["date"]).collect()}
    assert abs(back[DAY, 3] - (2 + phi[3] @ got[0].w)) < 1e-9


def test_log_marginal_is_the_full_gaussian():
    rng = np.random.default_rng(2)
    f, y = rng.random((12, 3)), rng.standard_normal(12)
    k = f @ f.T + 0.3 * np.eye(12)
    want = -0.5 * (y @ np.linalg.solve(k, y) + np.linalg.slogdet(k)[1] + 12 * np.log(2 * np.pi))
    assert abs(X.log_marginal(12, f.T @ f, f.T @ y, y @ y, 0.3) - want) < 1e-9


def test_subspace_and_modes(spark):
    rng = np.random.default_rng(3)
    w = rng.standard_normal((300, 3)) @ rng.standard_normal((3, 12))
    df = weights(spark, w)
    model = X.fit_subspace(df, 0.9999, least=1)
    mean, b, share = model[0]
    assert b.shape[1] == 3 and X.rank_report(df).iloc[0]["numerical"] == 3
    got = X.project(df, model).orderBy("t").first()
    assert np.allclose(got.z, b.T @ (w[0] - mean)) and np.allclose(got.complement, 0, atol=1e-8)
    r = rng.standard_normal((8, 20))
    res = spark.createDataFrame([(0, DAY + dt.timedelta(t), p, float(r[t, p])) for t in range(8) for p in range(20)], "field long, date date, pixel long, residual double")
    modes, energy = X.residual_modes(res, 0, 3)
    m = np.array([x.modes for x in modes.orderBy("pixel").collect()])
    s = np.linalg.svd(r)
    assert np.allclose(energy, s[1][:3] ** 2) and np.allclose(np.abs(m.T), np.abs(s[2][:3]))


def test_memory_operator(spark):
    a, w = trajectory()
    seen = np.random.default_rng(5).random(len(w)) > 0.1
    blocks, _, q = Y.fit_operator(Y.delay_line(weights(spark, w, seen), 2), mu=1e-9)[0]
    ok = [t for t in range(1, len(w) - 1) if seen[t - 1 : t + 2].all()]
    z, y = np.hstack([w[ok], w[[t - 1 for t in ok]]]), w[[t + 1 for t in ok]]
    want = np.linalg.lstsq(z, y, rcond=None)[0].T
    assert np.allclose(np.hstack(blocks), want, atol=1e-6) and np.abs(np.hstack(blocks) - np.hstack(a)).max() < 0.25 and np.linalg.eigvalsh(q).min() > 0
    inc = Y.fit_operator(Y.delay_line(weights(spark, w), 1), mu=1e-9, increment=True)[0][0][0]
    plain = Y.fit_operator(Y.delay_line(weights(spark, w), 1), mu=1e-9)[0][0][0]
    assert np.allclose(inc, plain, atol=1e-6)


def test_forced_operator(spark):
    rng = np.random.default_rng(6)
    a, b, w = np.diag([0.7, 0.5]), np.array([[1.0], [-0.5]]), np.zeros((300, 2))
    u = np.where(rng.random((300, 1)) < 0.3, rng.random((300, 1)), 0)
    for t in range(299):
        w[t + 1] = a @ w[t] + b @ u[t]
    df = weights(spark, w).join(spark.createDataFrame([(t, u[t].tolist()) for t in range(300)], "t long, u array<double>"), "t")
    d = Y.delay_line(df, 1, 1, "u")
    got = Y.fit_operator(d, mu=1e-9, forced=True)[0]
    assert np.allclose(got[0][0], a, atol=0.03) and np.allclose(got[1], b, atol=0.02)
    two = Y.two_stage(d, F.col("u")[0] == 0, mu=1e-9)[0]
    assert np.allclose(two[0][0], a, atol=0.02) and np.allclose(two[1], b, atol=0.02)


def test_rails():
    big = [1.4 * np.eye(2), 0.3 * np.eye(2)]
    assert abs(np.abs(np.linalg.eigvals(companion(Y.limit_radius(big)))).max() - 1) < 1e-9
    held, b = Y.limit_gain(big, 4, 2.0)
    assert Y.forecast_gain(held, 4) <= 2.0 and 0 <= b < 1
    assert np.abs(np.linalg.eigvals(Y.clip_eigenvalues(1.4 * np.eye(2)))).max() <= 1 + 1e-9
    a, w = trajectory()
    assert Y.blend_with_persistence(a, w[-80:], 3)[1] > 0.4
    assert np.linalg.matrix_rank(np.hstack(Y.reduced_rank_tail([np.eye(3), *[np.random.default_rng(i).random((3, 3)) for i in range(2)]], 1)[1:])) == 1
    rot = 0.9 * np.array([[np.cos(0.5), -np.sin(0.5)], [np.sin(0.5), np.cos(0.5)]])
    assert np.allclose(Y.koopman_modes(rot)["frequency"], 0.5 / (2 * np.pi)) and np.allclose(Y.koopman_modes(rot)["growth"], np.log(0.9))


def test_structured_kernels():
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3, 3))
    lag = [v @ np.diag(d) @ np.linalg.inv(v) for d in ([0.6, 0.4, 0.2], [0.2, 0.1, 0.3])]
    z = rng.standard_normal((20000, 6))
    y = z @ np.hstack(lag).T
    zz, zy = z.T @ z, z.T @ y
    got = Y.modal_kernel(zz, zy, 3, 2, mu=1e-9)
    assert np.allclose(np.hstack(got), np.hstack(lag), atol=0.05)
    a = np.diag([0.5, 0.4, 0.3])
    fit, alpha = Y.shared_lag_weights((zz, z.T @ (z @ np.hstack([a, 0.3 * a]).T)), 3, 2, mu=1e-9)
    assert np.allclose(fit, a, atol=1e-4) and abs(alpha[1] - 0.3) < 1e-4


def test_horizon_family_and_sweep(spark):
    _, w = trajectory(600)
    f = Y.horizon_family(weights(spark, w), 2, 3)
    assert list(f["lead"]) == [1, 2, 3] and f["defect"].iloc[0] < 1e-6 and (f["error"] > 0).all()
    s = {r.order: r for r in Y.memory_sweep(weights(spark, w), 3).collect()}
    assert s[2].rmse < s[1].rmse and s[3].n_parameters == 27 and s[3].last_ratio <= 1
    assert np.isinf(float("inf")) and (Y.horizon_fit(np.eye(2), np.eye(2), 3 * np.eye(2), 1.0, np.inf) == 3 * np.eye(2)).all()


def test_emission(spark):
    rng = np.random.default_rng(9)
    w, c = rng.standard_normal((400, 3)), rng.standard_normal((2, 3))
    y = w @ c.T + 0.1 * rng.standard_normal((400, 2))
    df = spark.createDataFrame([(0, t, w[t].tolist(), y[t].tolist()) for t in range(400)], "field long, t long, w array<double>, y array<double>")
    got = Y.emission_fit(df)[0]
    assert np.allclose(got["C"], c, atol=0.03) and min(got["r2"]) > 0.9 and got["usable"] and abs(got["R"][0, 0] - 0.01) < 0.003


def textbook(model, w, seen):
    """The dense lifted filter."""
    k, L = len(model["Q"]), len(model["A"])
    a = companion(model["A"])
    q = np.zeros_like(a)
    q[:k, :k] = model["Q"]
    h = np.hstack([np.eye(k), np.zeros((k, k * (L - 1)))])
    z, p, out = np.tile(w[0], L), np.eye(k * L), []
    for t in range(1, len(w)):
        z, p = a @ z, a @ p @ a.T + q
        if seen[t]:
            g = p @ h.T @ np.linalg.inv(h @ p @ h.T + model["R"])
            z, p = z + g @ (w[t] - h @ z), p - g @ h @ p
        out.append(z[:k])
    return np.array(out), a, z


def test_filter_and_forecasts(spark):
    a, w = trajectory(60)
    seen = np.random.default_rng(1).random(60) > 0.2
    seen[0] = seen[59] = True
    model = {"A": a, "Q": 0.01 * np.eye(3), "R": 0.02 * np.eye(3)}
    rows = weights(spark, w, seen).select("field", "t", "observed", "w")
    want, comp, z = textbook(model, w, seen)
    got = K.filtered(rows, {0: model}).orderBy("t").collect()
    assert np.allclose([r.w for r in got[1:]], want) and got[5].smoothed_t == 4
    f = K.rolling_forecasts(rows, {0: model}, {50, 59}, 4, K.VARIANTS[:1]).collect()
    last = sorted((r.lead, r.w, r.valid) for r in f if r.origin == 59)
    for h, x, valid in last:
        z = comp @ z
        assert np.allclose(x, z[:3]) and not valid
    assert all(r.valid for r in f if r.origin == 50)
    late = w.copy()
    late[55:] += 50  # what comes after an origin does not change its forecasts
    g = K.rolling_forecasts(weights(spark, late, seen).select("field", "t", "observed", "w"), {0: model}, {50}, 4, K.VARIANTS[:1]).collect()
    assert sorted((r.lead, r.w) for r in g) == sorted((r.lead, r.w) for r in f if r.origin == 50)
    plain = {(r.lead): r.w for r in f if r.origin == 50}
    used = {(r.lead): r.w for r in K.rolling_forecasts(rows, {0: model}, {50}, 4, K.VARIANTS[:1], assimilate=True).collect()}
    assert used[1] == plain[1] and (used[4] != plain[4]) == bool(seen[51:54].any())


def test_model_files(spark, tmp_path):
    a, _ = trajectory(10)
    path = str(tmp_path / "model")
    sinks.save_model(spark, {3: {"A": a, "Q": np.eye(3), "R": np.eye(3)}}, 50, path)
    got = sinks.load_model(spark, path, 50)[3]
    assert np.allclose(got["A"][1], a[1]) and len(got["A"]) == 2
    with pytest.raises(ValueError, match="pixels"):
        sinks.load_model(spark, path, 51)
    spark.read.parquet(path).withColumn("model_version", F.lit(3)).write.parquet(path + "3")
    with pytest.raises(ValueError, match="version"):
        sinks.load_model(spark, path + "3")
    spark.read.parquet(path).where("name <> 'Q'").write.parquet(path + "q")
    with pytest.raises(ValueError, match="missing"):
        sinks.load_model(spark, path + "q")


def field(spark, moving: float, n: int = 80, size: int = 10):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((size * 8, size))
    for _ in range(3):
        base = (base + np.roll(base, 1, 0) + np.roll(base, 1, 1)) / 3
    z, x = np.zeros((size, size)), []
    for t in range(n):
        new = np.roll(base, int(moving * t), 0)[:size] if moving else rng.standard_normal((size, size))
        z = new if moving else 0.8 * z + 0.6 * (new + np.roll(new, 1, 0) + np.roll(new, 1, 1)) / 1.7
        x.append(z)
    rows = [(DAY + dt.timedelta(t), i * size + j, i, j, float(x[t][i, j])) for t in range(n) for i in range(size) for j in range(size)]
    return np.array(x), spark.createDataFrame(rows, "date date, pixel long, row int, col int, value double")


def test_covariogram_and_separability(spark):
    x, df = field(spark, 0.0, 60, 8)
    df = df.withColumn("field", F.lit("a"))
    z = C.centred(df, "anomaly", C.always_valid(df))
    two = z.unionByName(z.withColumns({"field": F.lit("b"), "z": 2 * F.col("z")}))
    both = {(r.field, r.bin, r.u): r for r in C.covariogram(two, C.offset_table(spark, [1.0, 2.0]), 1, min_pairs=4).collect()}
    got = {(b, u): r for (f, b, u), r in both.items() if f == "a"}
    assert all(abs(both["b", b, u].cov - 4 * r.cov) < 1e-9 for (b, u), r in got.items())
    c = x - x.mean(0)
    pairs = [(c[:, i, j], c[:, i + a, j + b]) for _, a, b, _ in C.offsets([1.0, 2.0]) for i in range(8) for j in range(8) if 0 <= i + a < 8 and 0 <= j + b < 8]
    assert abs(got[0, 0].cov - np.mean([p * q for p, q in pairs])) < 1e-9
    assert abs(got[0, 1].cov - np.mean([0.5 * (p[:-1] * q[1:] + q[:-1] * p[1:]) for p, q in pairs])) < 1e-9 and got[0, 0].n_pairs == len(pairs)
    series = C.product_series(z, C.offset_table(spark, [2.0, 3.0]), 1, groups=8)
    assert not C.separability_test(series, [1], replicates=60, block=12, alpha=0.001)["reject"]


def test_whiteness(spark):
    rng = np.random.default_rng(5)
    white, red = rng.standard_normal((400, 3)), trajectory(400, noise=1.0)[1]
    make = lambda e: spark.createDataFrame([(0, t, e[t].tolist()) for t in range(len(e))], "field long, t long, e array<double>")
    for e, want in ((white, True), (red, False)):
        rho = T.autocorrelation(make(e), 6)
        z = e - e.mean(0)
        assert abs(rho.where("i = 1 and k = 2").first().rho - (z[2:, 1] * z[:-2, 1]).sum() / (z[:, 1] ** 2).sum()) < 1e-9
        assert T.whiteness_verdict(T.ljung_box(rho, 6), T.portmanteau(make(e), 6), alpha=0.001).first().white is want


def test_observers(spark):
    a = np.diag([0.9, 0.9, 0.5])
    assert O.cyclic_index(a) == 2
    phi = np.random.default_rng(0).random((20, 3))
    s = O.observable_sensors(a, phi)
    assert len(s) >= 2 and np.linalg.matrix_rank(np.vstack([phi[s] @ np.linalg.matrix_power(a, i) for i in range(3)])) == 3
