"""The parallel-scan filter and the four forecast variants against a plain loop, and horizon families against NumPy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldcast.functions.linalg import companion
from fieldcast.operators import dynamics as Y
from fieldcast.operators import filtering as K
from fieldcast.operators import horizons as H

KINDS = "field string, t long, observed boolean, w array<double>, u array<double>, m array<double>, cov array<double>"
LEADS = 3


def model(k: int, lags: int, rng, **more) -> dict:
    a = [0.5 / (j + 1) * np.linalg.qr(rng.standard_normal((k, k)))[0] for j in range(lags)]
    return {"A": a, "B": rng.standard_normal((k, 2)), "Q": 0.05 * np.eye(k) + 0.01, "R": 0.1 * np.eye(k), "C": rng.standard_normal((1, k)), "S": np.array([[0.2]]), **more}


def days(n: int, k: int, rng, first: int = 0) -> list[tuple]:
    """t, observed, w, u, m, cov: frames and measures are missing on some days."""
    out = []
    for t in range(first, first + n):
        seen = t > first + 1 and rng.random() < 0.7
        cov = rng.standard_normal((k, k))
        out.append((t, seen, rng.standard_normal(k), None if rng.random() < 0.1 else rng.standard_normal(2), None if rng.random() < 0.3 else rng.standard_normal(1), 0.05 * np.eye(k) + 0.02 * cov @ cov.T if seen and rng.random() < 0.5 else None))
    return out


def frame_of(spark, fields: dict):
    flat = lambda x: None if x is None else np.ravel(x).tolist()
    return spark.createDataFrame([(f, r[0], bool(r[1]), *map(flat, r[2:])) for f, rows in fields.items() for r in rows], KINDS).repartition(4)


class Plain:
    """The filter with dense matrices, a day after the other."""

    def __init__(self, m: dict, meets: bool = False):
        self.k, self.L = len(m["Q"]), len(m["A"])
        n = self.k * self.L
        self.m, self.a, self.h = m, companion(m["A"]), np.hstack([np.eye(self.k), np.zeros((self.k, n - self.k))])
        self.q = np.zeros((n, n))
        self.q[: self.k, : self.k] = m["Q"] + m.get("inflation", 0.0) * np.trace(m["Q"]) / self.k * np.eye(self.k)
        self.meets = meets

    def predict(self, z, p, u):
        z = self.a @ z
        if u is not None:
            z[: self.k] += self.m["B"] @ u
        return z, self.a @ p @ self.a.T + self.q

    def update(self, z, p, y, c, r):
        h = c @ self.h
        g = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
        return z + g @ (y - h @ z), p - g @ h @ p

    def run(self, rows):
        """{t: (z, p)} from the first seen day on."""
        z, out, before = None, {}, None
        for t, seen, w, u, m, cov in rows:
            if z is None and not seen:
                before = u
                continue
            new = z is None
            z, p = (np.tile(w, self.L), self.m.get("start", 1.0) * np.eye(self.k * self.L)) if new else self.predict(z, p, before)
            if not new or self.meets:
                if m is not None:
                    z, p = self.update(z, p, m, self.m["C"], self.m["S"])
                if seen:
                    z, p = self.update(z, p, w, np.eye(self.k), self.m["R"] if cov is None else cov)
            out[t], before = (z, p), u
        return out


@pytest.fixture(scope="module")
def fields():
    rng = np.random.default_rng(12)
    return {"long": days(95, 3, rng), "short": days(5, 3, rng, 40), "mid": days(23, 2, rng, 7)}, {f: model(k, lags, rng, inflation=0.3, **more) for f, k, lags, more in (("long", 3, 2, {"start": 0.4, "meets": True}), ("short", 3, 1, {}), ("mid", 2, 3, {}))}


@pytest.mark.parametrize("segment", [4, 365])
def test_scan_equals_the_loop(spark, fields, monkeypatch, segment):
    monkeypatch.setattr(K, "SEGMENT", segment)
    monkeypatch.setattr(K, "FAN", 3)  # with segments of 4 days, three levels of joining
    rows, models = fields
    df = frame_of(spark, rows)
    got = {(r.field, r.t): r for r in K.filtered(df, models).collect()}
    whole = {(r.field, r.t): r for r in K.states_at(df, models, df.where("t % 2 = 0")).collect()}
    want = {(f, t): x for f in rows for t, x in Plain(models[f], models[f].get("meets", False)).run(rows[f]).items()}
    assert got.keys() == want.keys() and {k for k in want if k[1] % 2 == 0} == whole.keys()
    for key, (z, p) in want.items():
        k = len(models[key[0]]["Q"])
        r = got[key]
        assert np.allclose(r.w, z[:k], atol=1e-9) and np.isclose(r.cov_trace, np.trace(p[:k, :k]), atol=1e-9) and np.allclose(r.smoothed, z[-k:], atol=1e-9)
        if key in whole:
            assert np.allclose(whole[key].z, z, atol=1e-9) and np.allclose(whole[key].cov, p.ravel(), atol=1e-9)


def test_one_field_is_many_tasks(spark, fields, monkeypatch):
    monkeypatch.setattr(K, "SEGMENT", 8)
    df = frame_of(spark, {"long": fields[0]["long"]})
    assert K.filtered(df, fields[1]).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_elements_join_associatively(fields):
    rows, models = fields
    lift = K.Lifted(models["long"])
    n, one = lift.k * lift.L, K.Element.nothing(lift.k * lift.L)
    measured = [(r[3], lift.sensors(r[4], r[2] if r[1] else None, r[5])) for r in rows["long"][:30]]

    def over(part):
        e = one
        for u, s in part:
            e = e.then(lift, u, s)
        return e

    a, b, c, whole = over(measured[:7]), over(measured[7:19]), over(measured[19:]), over(measured)
    for e in (a.joined(b).joined(c), a.joined(b.joined(c))):
        assert all(np.allclose(x, y, atol=1e-9) for x, y in zip(e, whole, strict=True))
    # On a state an element does what the days do.
    rng = np.random.default_rng(1)
    z, p = rng.standard_normal(n), np.eye(n)
    after = K.Element.state(z, p).joined(whole)
    for u, s in measured:
        z, p = lift.predict(z, p, u)
        for y, h, r in s:
            z, p, _ = lift.update(z, p, y, h, r)
    assert np.allclose(after.b, z, atol=1e-9) and np.allclose(after.c, p, atol=1e-9)


def brute_forecasts(rows: list, m: dict, plain: Plain, family: dict, assimilate: bool) -> dict:
    out, at = {}, {r[0]: r for r in rows}
    for origin, (z0, p0) in plain.run(rows).items():
        for direct in (False, True):
            for weather in (False, True):
                z, p = z0, p0
                us = [at[origin + i][3] if origin + i in at else None for i in range(LEADS)]
                for h in range(1, LEADS + 1):
                    day = at.get(origin + h)
                    if direct:
                        theta, sigma, maps = family[h]
                        mean = theta @ z0 + sum((b @ u for b, u in zip(maps, us, strict=False) if u is not None), np.zeros(plain.k))
                        z, p = np.r_[mean, np.zeros(len(z0) - plain.k)], np.zeros_like(p0)
                        p[: plain.k, : plain.k] = theta @ p0 @ theta.T + sigma
                    else:
                        z, p = plain.predict(z, p, us[h - 1])
                    before = z[: plain.k]
                    if weather and day is not None and day[4] is not None:
                        z, p = plain.update(z, p, day[4], m["C"], m["S"])
                    mean, cov = z[: plain.k], p[: plain.k, : plain.k]
                    if assimilate and not direct and day is not None and day[1]:
                        z, p = plain.update(z, p, day[2], np.eye(plain.k), m["R"] if day[5] is None else day[5])
                    out["direct" * direct + "recursive" * (not direct) + "+weather" * weather, origin, h] = (before, mean, cov, z[: plain.k], day is not None)
    return out


@pytest.mark.parametrize("assimilate", [False, True])
def test_four_variants(spark, fields, monkeypatch, assimilate):
    monkeypatch.setattr(K, "SEGMENT", 10)
    rows, models = fields
    rng = np.random.default_rng(3)
    family, table = {}, []
    for f in ("long", "mid"):  # the field without a family has no direct forecasts
        k, n = len(models[f]["Q"]), len(models[f]["Q"]) * len(models[f]["A"])
        family[f] = {h: (rng.standard_normal((k, n)), 0.1 * h * np.eye(k), [rng.standard_normal((k, 2)) for _ in range(h)]) for h in range(1, LEADS + 1)}
        table += [(f, h, a.ravel().tolist(), s.ravel().tolist(), np.hstack(b).ravel().tolist()) for h, (a, s, b) in family[f].items()]
    maps = spark.createDataFrame(table, "field string, lead int, map array<double>, sigma array<double>, inputs array<double>")
    got = {(r.field, r.variant, r.origin, r.lead): r for r in K.rolling_forecasts(frame_of(spark, rows), models, None, LEADS, K.VARIANTS, assimilate, maps, True).collect()}
    want = {}
    for f, m in models.items():
        plain = Plain(m, m.get("meets", False))
        all_ = brute_forecasts(rows[f], m, plain, family.get(f, {h: (np.zeros((plain.k, plain.k * plain.L)), np.eye(plain.k), []) for h in range(1, LEADS + 1)}), assimilate)
        want |= {(f, *key): x for key, x in all_.items() if f in family or not key[0].startswith("direct")}
    assert got.keys() == want.keys() and len({k[1] for k in got}) == 4
    for key, (before, mean, cov, after, valid) in want.items():
        r = got[key]
        assert np.allclose(r.w, mean, atol=1e-9) and np.allclose(r.before, before, atol=1e-9) and np.allclose(r.corrected, after, atol=1e-9)
        assert np.allclose(r.cov, cov.ravel(), atol=1e-9) and np.isclose(r.cov_trace, np.trace(cov), atol=1e-9) and r.valid is valid
    # Weather of the target day narrows a forecast; the filter up to the origin is one for all variants.
    both = [(got["long", "recursive", o, h], got["long", "recursive+weather", o, h]) for _, v, o, h in got if v == "recursive" and _ == "long"]
    assert all(b.cov_trace <= a.cov_trace + 1e-12 for a, b in both) and any(b.cov_trace < a.cov_trace - 1e-6 for a, b in both)


# ---- horizon families


def forced(n: int, seed: int = 2, bend: float = 0.0):
    """A memory of two lags with one input; bend adds what no linear memory model has."""
    rng = np.random.default_rng(seed)
    a = [np.array([[0.5, 0.2], [-0.1, 0.4]]), np.array([[0.2, 0.0], [0.1, 0.1]])]
    b, u, w = np.array([[0.5], [-0.3]]), rng.standard_normal((n, 1)), [rng.standard_normal(2), rng.standard_normal(2)]
    for t in range(1, n - 1):
        w.append(a[0] @ w[-1] + a[1] @ w[-2] + b @ u[t] + bend * np.sin(3 * w[max(0, t - 5)]) + 0.1 * rng.standard_normal(2))
    return a, b, u, np.array(w)


def weights_of(spark, w, u, seen=None, field="a"):
    seen = np.ones(len(w), bool) if seen is None else seen
    return spark.createDataFrame([(field, t, bool(seen[t]), w[t].tolist(), u[t].tolist()) for t in range(len(w))], "field string, t long, observed boolean, w array<double>, u array<double>")


def numpy_design(w, u, seen, lags, horizon):
    ok = [t for t in range(lags - 1, len(w) - horizon) if seen[t - lags + 1 : t + horizon + 1].all()]
    x = np.array([np.concatenate([w[t - j] for j in range(lags)]) for t in ok])
    return ok, x, np.array([np.concatenate(u[t : t + horizon]) for t in ok]), np.array([[w[t + h] for h in range(1, horizon + 1)] for t in ok])


@pytest.mark.parametrize(("criterion", "shrink"), [("gcv", False), ("holdout", True), ("likelihood", False), ("gcv", True)])
def test_horizon_rows(spark, criterion, shrink):
    a, b, u, w = forced(220, bend=0.3)
    seen = np.random.default_rng(4).random(220) > 0.03
    lags, horizon, mu = 2, 3, 0.1
    ok, x, fut, y = numpy_design(w, u, seen, lags, horizon)
    design = H.horizon_design(weights_of(spark, w, u, seen), lags, horizon, "u")
    assert sorted(r.t for r in design.collect()) == ok
    models = Y.fit_table(Y.delay_line(weights_of(spark, w, u, seen), lags, 1, "u"), mu=mu, forced=True)
    blocks, bb, q = Y.unpacked(models.first())
    got = {r.lead: r for r in H.horizon_rows(design, lags, horizon, models, criterion=criterion, mu=mu, shrink_inputs=shrink).collect()}
    n = len(ok)
    fit = n - max(1, round(0.15 * n))
    comp = companion(blocks)
    pushed = np.vstack([bb, np.zeros((2, 1))])
    for h in range(1, horizon + 1):
        z, t = np.hstack([x, fut[:, :h]]), y[:, h - 1]
        theta = np.linalg.matrix_power(comp, h)[:2]
        inputs = np.hstack([(np.linalg.matrix_power(comp, h - 1 - i) @ pushed)[:2] for i in range(h)])
        pi = np.r_[np.ones(4), np.full(h, float(shrink))]
        target = np.hstack([theta, inputs * shrink])

        def solve(z, t, nu):
            if math.isinf(nu):
                if shrink:
                    return np.hstack([theta, inputs])  # noqa: B023
                rest = t - z[:, :4] @ theta.T  # noqa: B023
                return np.hstack([theta, np.linalg.solve(z[:, 4:].T @ z[:, 4:] + mu * np.eye(h), z[:, 4:].T @ rest).T])  # noqa: B023
            return np.linalg.solve(z.T @ z + mu * np.eye(4 + h) + nu * np.diag(pi), (t.T @ z + nu * target).T).T  # noqa: B023

        def scored(nu):
            g = solve(z[:fit], t[:fit], nu)  # noqa: B023
            if criterion == "gcv":
                zz = z[:fit].T @ z[:fit]  # noqa: B023
                dof = np.trace(np.linalg.solve(zz + mu * np.eye(4 + h) + nu * np.diag(pi), zz)) if math.isfinite(nu) else (pi == 0).sum()  # noqa: B023
                return fit * ((t[:fit] - z[:fit] @ g.T) ** 2).sum() / (fit - dof) ** 2  # noqa: B023
            rest = t[fit:] - z[fit:] @ g.T  # noqa: B023
            if criterion == "holdout":
                return (rest**2).mean()
            cov = rest.T @ rest / (n - fit - 1)
            cov += 1e-8 * np.trace(cov) / 2 * np.eye(2)
            return 0.5 * ((rest @ np.linalg.inv(cov) * rest).sum() / (n - fit) + np.linalg.slogdet(cov)[1])

        best = min((scored(nu), nu) for nu in H.GRID)
        r, g = got[h], solve(z, t, best[1])
        assert r.nu == best[1] and np.isclose(r.score, best[0], rtol=1e-7) and r.n == n
        assert np.allclose(r.map, g[:, :4].ravel(), atol=1e-8) and np.allclose(r.inputs, g[:, 4:].ravel(), atol=1e-8) and np.allclose(r.target, theta.ravel(), atol=1e-9)
        rest = t - z @ g.T
        assert np.allclose(r.sigma, (rest.T @ rest / (n - 1)).ravel(), atol=1e-8)
        d = g[:, :4] - theta
        bias = np.trace(d @ np.cov(x, rowvar=False) @ d.T)
        assert np.isclose(r.defect, np.linalg.norm(d), atol=1e-9) and np.isclose(r.normalised, np.sqrt(bias / np.var(t, axis=0).sum()), atol=1e-9)
        real = t - z @ np.hstack([theta, inputs]).T
        assert np.isclose(r.trace_iterated, (real**2).sum() / (n - 1)) and np.isclose(r.trace_bias, bias, atol=1e-10)
        passed = sum(np.trace(p @ q @ p.T) for i in range(h) for p in [np.linalg.matrix_power(comp, i)[:2, :2]])
        assert np.isclose(r.trace_nominal, passed)


def test_horizon_ends_and_facts(spark):
    """The ends of the path are the direct and the iterated maps; a Markov process has hardly a defect, a bent one has."""
    _, _, u, w = forced(3000)
    got = {}
    for e in ("direct", "iterated", "shrunk"):
        got[e] = {r.lead: r for r in H.horizon_rows(H.horizon_design(weights_of(spark, w, u), 2, 3, "u"), 2, 3, estimator=e, mu=1e-6).collect()}
    assert all(r.nu == 0 and r.normalised < 0.05 for r in got["direct"].values()) and all(math.isinf(r.nu) and r.defect == 0 for r in got["iterated"].values())
    assert all(r.nu in H.GRID for r in got["shrunk"].values()) and got["direct"][1].defect < 1e-9
    for e in ("gcv", "holdout", "likelihood"):
        assert H.horizon_rows(H.horizon_design(weights_of(spark, w[:200], u), 2, 2, "u"), 2, 2, criterion=e).count() == 2
    _, _, u, bent = forced(3000, bend=0.6)
    rows = H.horizon_rows(H.horizon_design(weights_of(spark, bent, u), 1, 3, "u"), 1, 3, estimator="direct", mu=1e-6)
    c = {r.lead: r for r in H.coverage(rows).collect()}
    assert c[3].under > 1 and all(abs(r.identity) < 0.2 for r in c.values()) and rows.where("lead = 3").first().normalised > 0.05
    with pytest.raises(ValueError, match="criterion"):
        H.horizon_rows(rows, 1, 3, criterion="aic")
    with pytest.raises(ValueError, match="estimator"):
        H.horizon_rows(rows, 1, 3, estimator="best")


def test_direct_forecasts_use_the_family(spark):
    """Rows of horizon_rows are what the direct variants read."""
    _, _, u, w = forced(120)
    rows = weights_of(spark, w, u)
    models = Y.fit_table(Y.delay_line(rows, 2, 1, "u"), forced=True).withColumn("r", F.lit(0.1))
    family = H.horizon_rows(H.horizon_design(rows, 2, 3, "u"), 2, 3, models, estimator="direct")
    got = {(r.variant, r.lead): r for r in K.rolling_forecasts(rows, models, {80}, 3, K.VARIANTS, family=family).collect()}
    z = K.states_at(rows, models, rows.where("t = 80")).first().z
    for r in family.collect():
        mean = np.reshape(r.map, (2, 4)) @ z + sum(np.reshape(r.inputs, (2, r.lead))[:, i] * u[80 + i][0] for i in range(r.lead))
        assert np.allclose(got["direct", r.lead].w, mean)


def test_long_windows_are_cut(spark, monkeypatch):
    """Blocks with halos give what one window gives."""
    from fieldcast.functions import windows
    from fieldcast.operators import whiteness as T

    _, _, u, w = forced(150)
    rows = weights_of(spark, w, u, np.random.default_rng(5).random(150) > 0.1).unionByName(weights_of(spark, w[:9], u, field="b"))
    make = lambda: [
        sorted(map(tuple, Y.delay_line(rows, 3, 2, "u").collect())), sorted(map(tuple, T.differences(rows).collect())),
        sorted((r.field, r.i, r.k, round(r.rho, 12), r.n) for r in T.autocorrelation(T.differences(rows), 4).collect()), sorted((r.field, r.t, r.nth, r.n) for r in windows.numbered(rows).collect()),
    ]
    whole = make()
    for f in (windows.over_days, windows.numbered):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 7))
    cut = make()
    assert cut == whole and [x[2:] for x in whole[3]] == [(t + 1, n) for n in (150, 9) for t in range(n)]
