"""The lifted two-sensor Kalman filter as a parallel scan over segments of days, and forecasts from its states.

rows: (field, t, observed, w, [cov], [u], [m]), one for each day: the state that a frame shows and its covariance (null: the
model's noise), inputs, weather measures (null: none). models: a row a field, of dynamics.fit_table with further columns,
see Lifted.

What a segment of days does to the state before it, any Gaussian, is one element (A, b, C, eta, J), and elements join
associatively. So segments are worked out apart, their elements are joined in a tree, and each segment is then filtered
from its own start: a field of many days is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.functions.linalg import companion, symmetric
from fieldcast.operators.dynamics import limit_radius
from fieldcast.sources.stages import stored

#: Days of a segment, elements that are joined in one task at most, and numbers of the matrices that a task so holds.
SEGMENT, FAN, HELD = 365, 32, 1 << 21
#: Variance of the first state of each component, where a model row has none of its own.
FIRST = 1.0


class Lifted:
    """The state of L stacked vectors, its covariance, and the two updates: weather first, then the frame.

    model: A (blocks), B, Q, R (noise of frames), C and S (weather = C w + noise of covariance S), inflation (adds so many
    times the mean variance of Q to each component), start (variance of the first state; null: FIRST), meets (whether the first
    seen day's own weather and frame are used on that state, which only narrows it).
    """

    def __init__(self, model: dict):
        self.blocks = [np.asarray(b, float) for b in model["A"]]
        self.k, self.L = len(self.blocks[0]), len(self.blocks)
        self.top = np.hstack(self.blocks)
        self.B = np.asarray(model["B"], float) if model.get("B") is not None and np.size(model["B"]) else np.zeros((self.k, 0))
        self.Q, self.R = np.asarray(model["Q"], float), np.asarray(model["R"], float)
        self.Q = self.Q + (model.get("inflation") or 0.0) * np.trace(self.Q) / self.k * np.eye(self.k)
        self.C = np.asarray(model["C"], float) if model.get("C") is not None else None
        self.S = np.asarray(model["S"], float) if self.C is not None else None
        self.first = FIRST if model.get("start") is None else float(model["start"])
        self.meets = bool(model.get("meets"))

    def start(self, w: np.ndarray, sensors: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The first seen vector, repeated, after what the day measures if it is to be met."""
        z, p = np.tile(w, self.L), self.first * np.eye(self.k * self.L)
        for y, h, r in (sensors or []) if self.meets else []:
            z, p, _ = self.update(z, p, y, h, r)
        return z, p

    def pushed(self, x: np.ndarray) -> np.ndarray:
        """The companion matrix times x: only the first block is worked out, the others move down by one."""
        return np.concatenate([self.top @ x, x[: len(x) - self.k]])

    def predict(self, z: np.ndarray, p: np.ndarray, u: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        k, n = self.k, len(z)
        z = self.pushed(z)
        if u is not None and self.B.shape[1]:
            z[:k] += self.B @ u
        tp = self.top @ p
        out = np.empty_like(p)
        out[:k, :k] = symmetric(tp @ self.top.T) + self.Q
        out[:k, k:] = tp[:, : n - k]
        out[k:, :k] = out[:k, k:].T
        out[k:, k:] = p[: n - k, : n - k]
        return z, out

    def update(self, z: np.ndarray, p: np.ndarray, y: np.ndarray, h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A measurement y = h w + noise of the newest block; returns state, covariance, innovation."""
        ph = p[:, : self.k] @ h.T
        s = h @ ph[: self.k] + r
        gain = np.linalg.solve(s, ph.T).T
        e = y - h @ z[: self.k]
        return z + gain @ e, symmetric(p - gain @ ph.T), e

    def sensors(self, measure: np.ndarray | None, frame: np.ndarray | None, r: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(y, h, noise) of what a day measures, in order."""
        out = [(measure, self.C, self.S)] if measure is not None and self.C is not None else []
        return out + ([(frame, np.eye(self.k), self.R if r is None else r)] if frame is not None else [])

    def step(self, z, p, u_before, frame, measure, r=None):
        z, p = self.predict(z, p, u_before)
        e = None
        for y, h, noise in self.sensors(measure, frame, r):
            z, p, e = self.update(z, p, y, h, noise)
        return z, p, e if frame is not None else None


class Element(NamedTuple):
    """What a run of days does to a state N(m, P) before it: see after(). A state itself is an element with a = 0."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    eta: np.ndarray
    j: np.ndarray

    @classmethod
    def nothing(cls, n: int) -> Element:
        return cls(np.eye(n), np.zeros(n), np.zeros((n, n)), np.zeros(n), np.zeros((n, n)))

    @classmethod
    def state(cls, m: np.ndarray, p: np.ndarray) -> Element:
        n = len(m)
        return cls(np.zeros((n, n)), m, p, np.zeros(n), np.zeros((n, n)))

    def then(self, lift: Lifted, u_before: np.ndarray | None, sensors: list) -> Element:
        """With one more day: the filter from the start 0 with covariance 0, and how the start moves it and is told by it."""
        a, (b, c), eta, j = lift.pushed(self.a), lift.predict(self.b, self.c, u_before), self.eta, self.j
        for y, h, r in sensors:
            ph, ha = c[:, : lift.k] @ h.T, h @ a[: lift.k]
            s = h @ ph[: lift.k] + r
            e = y - h @ b[: lift.k]
            told = np.linalg.solve(s, np.column_stack([ha, e]))
            gain = np.linalg.solve(s, ph.T).T
            j, eta = symmetric(j + ha.T @ told[:, :-1]), eta + ha.T @ told[:, -1]
            a, b, c = a - gain @ ha, b + gain @ e, symmetric(c - gain @ ph.T)
        return Element(a, b, c, eta, j)

    def joined(self, after: Element) -> Element:
        """This run and then the other, as one."""
        mid = np.linalg.solve((np.eye(len(self.b)) + self.c @ after.j).T, after.a.T).T  # a2 (I + c1 j2)^-1
        back = np.linalg.solve(np.eye(len(self.b)) + after.j @ self.c, np.column_stack([after.j @ self.a, after.eta - after.j @ self.b]))
        return Element(
            mid @ self.a,
            mid @ (self.b + self.c @ after.eta) + after.b,
            symmetric(mid @ self.c @ after.a.T + after.c),
            self.a.T @ back[:, -1] + self.eta,
            symmetric(self.a.T @ back[:, :-1] + self.j),
        )


def _vector(x) -> np.ndarray | None:
    if x is None or (isinstance(x, float) and np.isnan(x)):
        return None
    v = np.array([np.nan if a is None else a for a in x], float)
    return v if np.isfinite(v).all() else None


def _lift(row) -> Lifted:
    """Lifted of a model row, in which matrices are row by row."""
    k = int(row.k)
    has = lambda name: (x := getattr(row, name, None)) is not None and not (isinstance(x, float) and np.isnan(x))
    of = lambda name, *shape: np.asarray(getattr(row, name), float).reshape(*shape) if has(name) else None
    noise = of("noise", k, k)
    c = of("c", -1, k)
    return Lifted(
        {
            "A": of("a", int(row.lags), k, k), "B": of("b", k, -1) if has("b") else None, "Q": of("q", k, k), "R": row.r * np.eye(k) if noise is None else noise,
            "C": c, "S": None if c is None else of("s", len(c), len(c)), "inflation": row.inflation if has("inflation") else 0.0, "start": row.start if has("start") else None,
            "meets": has("meets") and bool(row.meets),
        }
    )


def model_rows(spark: SparkSession, models: dict, kind: str) -> DataFrame:
    """Models held as dictionaries by field, with the keys of Lifted, as rows."""
    flat = lambda x: None if x is None else np.ravel(np.asarray(x, float)).tolist()
    rows = [(f, len(m["Q"]), len(m["A"]), flat(m["A"]), flat(m.get("B")) or [], flat(m["Q"]), flat(m["R"]), flat(m.get("C")), flat(m.get("S")), m.get("inflation"), m.get("start"), m.get("meets")) for f, m in models.items()]
    return spark.createDataFrame(rows, f"field {kind}, k int, lags int, a array<double>, b array<double>, q array<double>, noise array<double>, c array<double>, s array<double>, inflation double, start double, meets boolean")


def _within_radius(models: DataFrame) -> DataFrame:
    """models with blocks held to the spectral radius rho, where that is given, once for each row."""
    if "rho" not in models.columns:
        return models

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["a"] = [
                a if rho is None or np.isnan(rho) else np.ravel(limit_radius(list(np.asarray(a).reshape(int(n), int(k), int(k))), rho))
                for a, rho, n, k in zip(f["a"], f["rho"], f["lags"], f["k"], strict=True)
            ]
            yield f

    return models.mapInPandas(task, models.schema).drop("rho")


def _dealt(df: DataFrame) -> DataFrame:
    """By field and segment, into as many parts as the session has for shuffles: small parts are tasks all the same."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "field", "seg")


def _together(rows: DataFrame, right: DataFrame, one, schema: str) -> DataFrame:
    """one(rows of a segment, what is known of it) for each segment that both have."""
    names = [c.split()[0] for c in schema.split(", ")]

    def both(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        return one(f, m) if len(f) and len(m) else pd.DataFrame(columns=names)

    return _dealt(rows).groupBy("field", "seg").cogroup(_dealt(right).groupBy("field", "seg")).applyInPandas(both, schema)


def _days(f: pd.DataFrame, seg: int | None = None) -> Iterator[tuple[int, np.ndarray | None, list, np.ndarray | None]]:
    """(position, input of the day before, (measure, frame, covariance) of the day, frame) of rows in order; of a segment's own
    days alone if given."""
    us, ms, covs = (f[c].to_list() if c in f else [None] * len(f) for c in ("u", "m", "cov"))
    seen, ws, own = f["observed"].to_numpy(bool), f["w"].to_list(), f["own"].to_numpy()
    for i in range(len(f)):
        if seg is not None and own[i] != seg:
            continue
        frame = _vector(ws[i]) if seen[i] else None
        cov = _vector(covs[i]) if frame is not None else None
        yield i, _vector(us[i - 1]) if i else None, [_vector(ms[i]), frame, None if cov is None else cov.reshape(len(frame), -1)], frame


def _run(f: pd.DataFrame, row, seg: int) -> Iterator[tuple]:
    """(position, lift, state, covariance, innovation, state before the frame) of the days of a segment. row: the model, and m and
    p, the state on the day before (null for the first segment, which begins with the first seen day)."""
    lift, z, p = _lift(row), _vector(getattr(row, "m", None)), None
    if z is not None:
        p = np.asarray(row.p, float).reshape(len(z), -1)
    for i, u, (measure, frame, cov), _ in _days(f, seg):
        if z is None:
            z, p = lift.start(frame, lift.sensors(measure, frame, cov))
            yield i, lift, z, p, None, frame
            continue
        z, p = lift.predict(z, p, u)
        e, before = None, z[: lift.k]
        for y, h, r in lift.sensors(measure, frame, cov):
            if y is frame:
                before = z[: lift.k]
            z, p, e = lift.update(z, p, y, h, r)
        yield i, lift, z, p, e if frame is not None else None, before


_ELEMENT = "a array<double>, b array<double>, c array<double>, eta array<double>, j array<double>"


def _flat(e: Element) -> list:
    return [np.ravel(x) for x in e]


def _elements(f: pd.DataFrame) -> list[tuple[int, Element]]:
    out = []
    for r in f.sort_values("seg").itertuples():
        n = len(r.b)
        out.append((int(r.seg), Element(np.asarray(r.a).reshape(n, n), np.asarray(r.b), np.asarray(r.c).reshape(n, n), np.asarray(r.eta), np.asarray(r.j).reshape(n, n))))
    return out


def _fan(size: int) -> int:
    """How many elements of states of a length are joined in one task: wide ones are few, so that their matrices fit."""
    return min(max(HELD // (3 * size * size), 4), FAN)


def _starts(elements: DataFrame, last: int, kind: str, fan: int = FAN) -> DataFrame:
    """(field, seg, m, p): the state on the day before a segment, for all but the first. elements: (field, seg, a, b, c, eta, j)
    of all but the last, the first of a field a state; last: the largest seg of any. `fan` of them are joined in a task, these
    results likewise, and so on; on the way back each task goes on from the state before its own."""
    schema = f"field {kind}, seg long, m array<double>, p array<double>"

    def walk(f: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        now, out = None, []
        if len(before):
            m = np.asarray(before["m"].iloc[0])
            now = Element.state(m, np.asarray(before["p"].iloc[0]).reshape(len(m), -1))
        for seg, e in _elements(f) if len(f) else ():
            now = e if now is None else now.joined(e)
            out.append((f["field"].iloc[0], seg + 1, now.b, now.c.ravel()))
        return pd.DataFrame(out, columns=["field", "seg", "m", "p"])

    def join(f: pd.DataFrame) -> pd.DataFrame:
        (_, whole), *rest = _elements(f)
        for _, e in rest:
            whole = whole.joined(e)
        return pd.DataFrame([(f["field"].iloc[0], int(f["part"].iloc[0]), *_flat(whole))], columns=["field", "seg", "a", "b", "c", "eta", "j"])

    parted = stored(elements.withColumn("part", F.floor(F.col("seg") / fan)), "elements")
    if last <= fan:
        above = elements.sparkSession.createDataFrame([], schema)
    else:
        above = _starts(parted.groupBy("field", "part").applyInPandas(join, f"field {kind}, seg long, {_ELEMENT}"), (last - 1) // fan, kind, fan)
    above = above.withColumnRenamed("seg", "part")
    return parted.groupBy("field", "part").cogroup(above.groupBy("field", "part")).applyInPandas(walk, schema)


def _scanned(rows: DataFrame, models: dict | DataFrame, ahead: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows, right) by field and seg for _together(): a segment's rows, with the day before and `ahead` days after it, and its
    model with the state that it starts from."""
    spark, kind = rows.sparkSession, dict(rows.dtypes)["field"]
    models = _within_radius(model_rows(spark, models, kind) if isinstance(models, dict) else models)
    fits = F.forall("w", lambda x: x.isNotNull() & ~F.isnan(x))
    first = rows.where(F.col("observed") & F.coalesce(fits, F.lit(False))).groupBy("field").agg(F.min("t").alias("t0"))
    rows = stored(rows.join(first, "field").where("t >= t0").withColumn("own", F.floor((F.col("t") - F.col("t0")) / SEGMENT)), "days")
    top = rows.groupBy("field").agg(F.max("own").alias("top"))
    right = models.join(top.select("field", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("seg")), "field")
    at, lead = F.col("t") - F.col("t0"), rows.join(top, "field")
    near = F.sequence(F.greatest(F.floor((at - ahead) / SEGMENT), F.lit(0)), F.least(F.floor((at + 1) / SEGMENT), "top"))
    wide = lead.withColumn("seg", F.explode(near)).drop("top", "t0")
    last = top.agg(F.max("top")).first()[0] or 0
    if not last:
        return wide, right.withColumns({"m": F.lit(None).cast("array<double>"), "p": F.lit(None).cast("array<double>")})

    def work(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        f, row, seg = f.sort_values("t").reset_index(drop=True), next(m.itertuples()), int(m["seg"].iloc[0])
        if seg == 0:
            for _, _, z, p, _, _ in _run(f, row, 0):
                pass
            e = Element.state(z, p)
        else:
            lift = _lift(row)
            e = Element.nothing(lift.k * lift.L)
            for _, u, measured, _ in _days(f, seg):
                e = e.then(lift, u, lift.sensors(*measured))
        return pd.DataFrame([(f["field"].iloc[0], seg, *_flat(e))], columns=["field", "seg", "a", "b", "c", "eta", "j"])

    ends = right.join(top, "field").where("seg < top").drop("top")  # the last segment of a field starts nothing
    size = models.agg(F.max(F.col("k") * F.col("lags"))).first()[0] or 1
    starts = _starts(_together(wide, ends, work, f"field {kind}, seg long, {_ELEMENT}"), last, kind, _fan(int(size)))
    return wide, right.join(stored(starts, "starts"), ["field", "seg"], "left")


def filtered(rows: DataFrame, models: dict | DataFrame) -> DataFrame:
    """(field, t, w, cov_trace, prior, innovation, smoothed, smoothed_t): the filtered vector of each day from the first seen one on.

    prior is the vector before the day's frame, after its weather; innovation the frame less it, null without a frame.
    smoothed is the last block of the lifted state: the vector of day t - L + 1 with all that came until t.
    """
    kind = dict(rows.dtypes)["field"]

    def one(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t").reset_index(drop=True)
        out = []
        for i, x, z, p, e, prior in _run(f, next(m.itertuples()), int(m["seg"].iloc[0])):
            t = int(f["t"].iloc[i])
            out.append((f["field"].iloc[i], t, z[: x.k].tolist(), float(np.trace(p[: x.k, : x.k])), prior.tolist(), None if e is None else e.tolist(), z[-x.k :].tolist(), t - x.L + 1))
        return pd.DataFrame(out, columns=["field", "t", "w", "cov_trace", "prior", "innovation", "smoothed", "smoothed_t"])

    return _together(*_scanned(rows, models), one, f"field {kind}, t long, w array<double>, cov_trace double, prior array<double>, innovation array<double>, smoothed array<double>, smoothed_t long")


def states_at(rows: DataFrame, models: dict | DataFrame, days: DataFrame) -> DataFrame:
    """(field, t, z, cov): the whole lifted state and its covariance, row by row, on some days (field, t)."""
    kind = dict(rows.dtypes)["field"]
    wanted = rows.join(days.select("field", "t").distinct().withColumn("wanted", F.lit(True)), ["field", "t"], "left")

    def one(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t").reset_index(drop=True)
        out = [(f["field"].iloc[i], int(f["t"].iloc[i]), z.tolist(), p.ravel().tolist()) for i, _, z, p, _, _ in _run(f, next(m.itertuples()), int(m["seg"].iloc[0])) if f["wanted"].iloc[i]]
        return pd.DataFrame(out, columns=["field", "t", "z", "cov"])

    return _together(*_scanned(wanted.withColumn("wanted", F.coalesce("wanted", F.lit(False))), models), one, f"field {kind}, t long, z array<double>, cov array<double>")


def _variant(direct: bool, weather: bool) -> dict:
    return {"variant": ("direct" if direct else "recursive") + "+weather" * weather, "direct": direct, "weather": weather}


#: The four variants: recursive ones first.
VARIANTS = tuple(_variant(d, w) for d in (False, True) for w in (False, True))


def branch(lift: Lifted, z: np.ndarray, p: np.ndarray, horizon: int, direct: dict | None, inputs: list, measures: list, frames: list) -> Iterator[tuple]:
    """(lead, mean before weather, mean, covariance, mean with the frame too) from a state, a row for each lead.

    inputs: u of the origin and the days after it (None: 0); measures, frames: of the days after it (None: none). direct: None
    iterates the model, corrected as it goes on. Else {lead: (map of the state, covariance, maps of the inputs)}: each lead
    by its own map, with the lead's own covariance, corrected by that day's weather alone.
    """
    z0, p0, k = z, p, lift.k
    for h in range(1, horizon + 1):
        if direct is None:
            z, p = lift.predict(z, p, inputs[h - 1])
        else:
            theta, sigma, maps = direct[h]
            z = theta @ z0
            for m, u in zip(maps, inputs, strict=False):
                z = z + (m @ u if u is not None else 0)
            p = symmetric(theta @ p0 @ theta.T) + sigma
        before = z[:k]
        if measures[h - 1] is not None and lift.C is not None:
            z, p, _ = lift.update(z, p, measures[h - 1], lift.C, lift.S)
        mean, cov = z[:k], p[:k, :k]
        if frames[h - 1] is not None and direct is None:
            z, p, _ = lift.update(z, p, frames[h - 1][0], np.eye(k), frames[h - 1][1])
        yield h, before, mean, cov, z[:k]


def _direct_maps(row, lift: Lifted) -> dict:
    out, n, ell = {}, lift.k * lift.L, lift.B.shape[1]
    for x in row.family:
        sigma = np.zeros((lift.k, lift.k)) if x["sigma"] is None else np.asarray(x["sigma"]).reshape(lift.k, -1)
        maps = np.zeros((0, lift.k, ell)) if x["inputs"] is None or not ell else np.asarray(x["inputs"]).reshape(lift.k, -1, ell).transpose(1, 0, 2)
        out[int(x["lead"])] = (np.asarray(x["map"]).reshape(lift.k, n), sigma, maps)
    return out


def rolling_forecasts(
    rows: DataFrame, models: dict | DataFrame, origins: set[int] | None, horizon: int, variants: tuple = VARIANTS[:2], assimilate: bool = False,
    family: DataFrame | None = None, covariances: bool = False,
) -> DataFrame:
    """(field, variant, origin, lead, w, cov_trace, before, corrected, valid[, cov]): forecasts of each origin day by each
    variant from one filter pass.

    Recursive variants iterate the model; direct ones use the rows of `family` (dynamics.horizon_family: field, lead, map,
    sigma, inputs), one for each lead; a field without them has no direct forecasts. weather variants also use the measures
    after the origin, before is the mean without the target day's. Inputs past the end are 0, measures there are missing;
    valid means that the target is in the calendar. With assimilate, a lead's forecast w is noted first and its own frame,
    if there is one, is used for the leads after it; corrected has it, and else equals w. origins None: every filtered day.
    """
    kind = dict(rows.dtypes)["field"]
    names = ["field", "variant", "origin", "lead", "w", "cov_trace", "before", "corrected", "valid", *(["cov"] if covariances else [])]

    def one(f: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t").reset_index(drop=True)
        row, field, n, ts = next(m.itertuples()), f["field"].iloc[0], len(f), f["t"].to_numpy()
        us, ms, covs = ([_vector(x) for x in f[c]] if c in f else [None] * n for c in ("u", "m", "cov"))
        seen, ws, direct, out = f["observed"].to_numpy(bool), f["w"].to_list(), None, []
        for i, lift, z, p, _, _ in _run(f, row, int(m["seg"].iloc[0])):
            if origins is not None and int(ts[i]) not in origins:
                continue
            if direct is None:
                direct = _direct_maps(row, lift) if getattr(row, "family", None) is not None else {}
            days = range(i + 1, i + 1 + horizon)
            frames = [None] * horizon
            if assimilate:
                seen_at = [(_vector(ws[j]), covs[j]) if j < n and seen[j] else (None, None) for j in days]
                frames = [None if y is None else (y, lift.R if c is None else c.reshape(lift.k, -1)) for y, c in seen_at]
            for v in variants:
                if v["direct"] and len(direct) < horizon:
                    continue
                measures = [ms[j] if v["weather"] and j < n else None for j in days]
                inputs = [us[j - 1] if j - 1 < n else None for j in days]
                for h, before, mean, cov, after in branch(lift, z, p, horizon, direct if v["direct"] else None, inputs, measures, frames):
                    made = (field, v["variant"], int(ts[i]), h, mean.tolist(), float(np.trace(cov)), before.tolist(), after.tolist(), i + h < n)
                    out.append((*made, cov.ravel().tolist()) if covariances else made)
        return pd.DataFrame(out, columns=names)

    if isinstance(models, dict):
        models = model_rows(rows.sparkSession, models, kind)
    if family is not None:
        leads = family.groupBy("field").agg(F.sort_array(F.collect_list(F.struct("lead", "map", "sigma", "inputs"))).alias("family"))
        models = models.join(leads, "field", "left")
    schema = f"field {kind}, variant string, origin long, lead int, w array<double>, cov_trace double, before array<double>, corrected array<double>, valid boolean" + ", cov array<double>" * covariances
    return _together(*_scanned(rows, models, horizon), one, schema)


def dense_forecast(blocks: list[np.ndarray], z: np.ndarray, horizon: int) -> list[np.ndarray]:
    """The forecasts of the plain companion form, for tests and small uses."""
    a, out = companion(blocks), []
    for _ in range(horizon):
        z = a @ z
        out.append(z[: len(blocks[0])])
    return out
