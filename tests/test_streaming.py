"""Streams from files, run over all that is there, against the batch answers."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from fieldcast.operators import filtering as K
from fieldcast.streaming import jobs as J

DAY = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, files: int = 1):
    path = str(tmp_path / "in")
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_daily_means_and_totals(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(0, int(z), DAY + dt.timedelta(days=int(d), hours=int(h)), float(v)) for d in range(12) for z, h, v in zip(rng.integers(0, 2, 5), rng.integers(0, 24, 5), rng.random(5), strict=True)]
    s = stream(spark, tmp_path, rows, "field long, zone long, ts timestamp, value double")
    got = {(r.zone, r.day): round(r.value, 9) for r in J.run_available(J.daily_means(s), "means").collect()}
    want = {}
    for _, z, t, v in rows:
        want.setdefault((z, t.date()), []).append(v)
    assert got and all(abs(v - np.mean(want[k])) < 1e-8 for k, v in got.items())
    tot = {r.end: r.total for r in J.run_available(J.trailing_totals(s, 3), "totals").collect()}
    end = dt.date(2024, 1, 6)
    assert abs(tot[end] - sum(v for _, _, t, v in rows if dt.date(2024, 1, 3) <= t.date() < end)) < 1e-9


def test_runs_and_repeats(spark, tmp_path):
    days = [0, 1, 2, 2, 5, 6, 20]
    s = stream(spark, tmp_path, [(0, DAY + dt.timedelta(days=d, hours=3)) for d in days], "field long, ts timestamp")
    got = sorted((r.first.day, r.days, r.enough) for r in J.run_available(J.observed_runs(s, 3), "runs").collect())
    assert got[:2] == [(1, 3, True), (6, 2, False)]
    assert J.run_available(J.one_frame_a_day(s), "once").count() == 6
    assert [(r.day.day, r.n) for r in J.run_available(J.repeated_frames(s), "repeats").collect()] == [(3, 2)]


def test_online_filter_matches_batch_with_late_frames(spark, tmp_path):
    rng = np.random.default_rng(1)
    w = rng.standard_normal((10, 2)).cumsum(0)
    model = {"A": [0.8 * np.eye(2), 0.1 * np.eye(2), 0.05 * np.eye(2)], "Q": 0.1 * np.eye(2), "R": 0.2 * np.eye(2)}
    order = [0, 1, 2, 4, 3, 5, 7, 6, 8, 9, 1]
    rows = [(0, t, w[t].tolist()) for t in order]
    s = stream(spark, tmp_path, rows, "field long, t long, w array<double>", files=len(rows))
    got = J.run_available(J.online_filter(s, model, 2), "online").collect()
    batch = spark.createDataFrame([(0, t, True, w[t].tolist()) for t in range(10)], "field long, t long, observed boolean, w array<double>")
    want = {(r.origin, r.lead): r.w for r in K.rolling_forecasts(batch, {0: model}, None, 2, K.VARIANTS[:1]).collect()}
    last = {(r.t, r.lead): r.w for r in got if not r.refused and (r.t != 4 or r.late) and (r.t != 7 or r.late)}
    assert all(np.allclose(last[9, h], want[9, h]) and np.allclose(last[4, h], want[4, h]) for h in (1, 2))
    assert [r.t for r in got if r.refused] == [1]


def test_live_scores(spark, tmp_path):
    f = stream(spark, tmp_path / "f", [(0, 1, 1, DAY + dt.timedelta(days=d), 2.0) for d in range(4)], "field long, pixel long, lead int, target timestamp, pred double")
    t = stream(spark, tmp_path / "t", [(0, 1, DAY + dt.timedelta(days=d), float(d)) for d in range(4)], "field long, pixel long, ts timestamp, value double")
    got = J.run_available(J.live_scores(f, t, 6), "live")
    assert sorted(r.error for r in got.collect()) == [-1.0, 0.0, 1.0, 2.0] and got.where(F.col("lead") != 1).count() == 0


def test_live_filter(spark, tmp_path):
    """Frames that come late are put into their place, days that end without one are filtered by timers, and what is too old is refused.
    The last forecasts of each day are those of the batch filter over what had come by then."""
    rng = np.random.default_rng(1)
    w = rng.standard_normal((16, 2)).cumsum(0)
    model = {"A": [0.8 * np.eye(2), 0.1 * np.eye(2), 0.05 * np.eye(2)], "Q": 0.1 * np.eye(2), "R": 0.2 * np.eye(2)}
    base = (DAY.date() - dt.date(1970, 1, 1)).days if isinstance(DAY, dt.datetime) else (DAY - dt.date(1970, 1, 1)).days
    at = lambda t: dt.datetime(1970, 1, 1) + dt.timedelta(days=base + t, hours=6)
    order = [0, 1, 2, 4, 3, 5, 1, 9, 15]
    rows = [(0, at(t), w[t].tolist()) for t in order]
    s = stream(spark, tmp_path, rows, "field long, ts timestamp, w array<double>", files=len(rows))
    with J.rocks(spark):
        got = J.run_available(J.live_filter(s, model, 2, "4 days", silent=3), "live").collect()
    rows = [(r.t - base, r.lead, r.w, r.kind) for r in got]

    def batch(seen, origin):
        b = spark.createDataFrame([(0, t, t in seen, w[t].tolist()) for t in range(origin + 1)], "field long, t long, observed boolean, w array<double>")
        return {r.lead: r.w for r in K.rolling_forecasts(b, {0: model}, {origin}, 2, K.VARIANTS[:1]).collect()}

    of = lambda t, kind: {h: x for u, h, x, k in rows if (u, k) == (t, kind) and h}
    for origin, kind, seen in ((4, "frame", {0, 1, 2, 4}), (4, "late", {0, 1, 2, 3, 4}), (5, "frame", {0, 1, 2, 3, 4, 5}), (9, "frame", {0, 1, 2, 3, 4, 5, 9}), (15, "frame", {0, 1, 2, 3, 4, 5, 9, 15})):
        want, have = batch(seen, origin), of(origin, kind)
        assert have.keys() == want.keys() and all(np.allclose(have[h], want[h]) for h in want), (origin, kind)
    assert [(t, k) for t, h, _, k in rows if k == "refused"] == [(1, "refused")]
    # Day 15 moves the watermark to day 11: the days after the ninth that ended by then had no frame.
    silent = sorted({t for t, _, _, k in rows if k == "silent"})
    assert silent == [] or all(9 < t < 15 for t in silent)
    for t in silent:
        assert all(np.allclose(of(t, "silent")[h], batch({0, 1, 2, 3, 4, 5, 9}, t)[h]) for h in (1, 2))


def test_silent_days_end(spark, tmp_path):
    """A field that falls silent while others go on is forecast for so many days and then let be."""
    model = {"A": [0.9 * np.eye(1)], "Q": np.eye(1), "R": np.eye(1)}
    at = lambda t: dt.datetime(2024, 1, 1) + dt.timedelta(days=t, hours=6)
    rows = [(0, at(0), [1.0]), (1, at(0), [1.0]), *[(1, at(t), [1.0]) for t in range(1, 12)]]
    s = stream(spark, tmp_path, rows, "field long, ts timestamp, w array<double>", files=len(rows))
    with J.rocks(spark):
        got = J.run_available(J.live_filter(s, model, 1, "1 day", silent=4), "silent").collect()
    first = (dt.date(2024, 1, 1) - dt.date(1970, 1, 1)).days
    own = sorted((r.t - first, r.kind, round(r.w[0], 9)) for r in got if r.field == 0)
    assert own == [(0, "frame", 0.9), *[(t, "silent", round(0.9 ** (t + 1), 9)) for t in range(1, 5)]]
    assert sorted(r.t - first for r in got if r.field == 1 and r.kind == "frame") == list(range(12))


def test_chained_scores_wait_for_the_truth(spark, tmp_path):
    rows = [(0, DAY + dt.timedelta(days=d, hours=h), float(d)) for d in (0, 1, 2, 5, 6, 12) for h in (1, 2)]
    read = lambda n: stream(spark, tmp_path / n, rows, "field long, ts timestamp, value double", files=3).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "field").agg(F.avg("value").alias("value"))
    got = J.run_available(J.chained_scores(read("a"), read("b")), "chained").collect()
    first = DAY.date() if isinstance(DAY, dt.datetime) else DAY
    assert sorted(((r.day - first).days, r.pred, r.value) for r in got) == [(1, 0.0, 1.0), (2, 1.0, 2.0), (3, 2.0, None), (6, 5.0, 6.0), (7, 6.0, None)]
