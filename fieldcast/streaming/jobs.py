"""Structured Streaming forms of the daily jobs. Streams have (field, .., ts timestamp)."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fieldcast.operators.filtering import Lifted, _vector
from fieldcast.sources.stages import shared_dir


def daily_means(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """(field, zone, day, value, n): a tumbling day for each zone."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "field", "zone")
    return w.agg(F.avg("value").alias("value"), F.count("value").alias("n")).select("field", "zone", F.col("window.start").cast("date").alias("day"), "value", "n")


def trailing_totals(stream: DataFrame, days: int = 32, delay: str = "3 days") -> DataFrame:
    """(field, end, total): sums over the `days` days before each day's end, by sliding windows."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", f"{days} days", "1 day"), "field")
    return w.agg(F.sum("value").alias("total")).select("field", F.col("window.end").cast("date").alias("end"), "total")


def observed_runs(stream: DataFrame, order: int, delay: str = "3 days") -> DataFrame:
    """(field, first, last, days, enough): runs of days with frames; a run ends with a day without one."""
    daily = stream.withColumn("ts", F.date_trunc("day", "ts")).withWatermark("ts", delay)
    w = daily.groupBy(F.session_window("ts", "36 hours"), "field").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = F.datediff("b", "a") + 1
    return w.select("field", F.col("a").cast("date").alias("first"), F.col("b").cast("date").alias("last"), days.alias("days"), (days >= order).alias("enough"))


def one_frame_a_day(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """The first row to arrive of each field and day."""
    day = stream.withColumn("ts", F.date_trunc("day", "ts")).withWatermark("ts", delay)
    return day.dropDuplicatesWithinWatermark(["field", "ts"])


def repeated_frames(stream: DataFrame, delay: str = "3 days") -> DataFrame:
    """(field, day, n) of days with several frames."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "field").agg(F.count("*").alias("n")).where("n > 1").select("field", F.col("window.start").cast("date").alias("day"), "n")


def live_scores(forecasts: DataFrame, truth: DataFrame, horizon: int, delay: str = "1 day") -> DataFrame:
    """Forecasts (field, pixel, lead, target ts, pred) met with frames (field, pixel, ts, value) when they arrive."""
    f = forecasts.withWatermark("target", f"{horizon} days").alias("f")
    t = truth.withWatermark("ts", delay).alias("t")
    on = F.expr("f.field = t.field AND f.pixel = t.pixel AND f.target = t.ts")
    return f.join(t, on).select("f.field", "f.pixel", "f.lead", "f.target", (F.col("f.pred") - F.col("t.value")).alias("error"))


OUT = "field long, t long, lead int, w array<double>, late boolean, refused boolean"


def online_filter(stream: DataFrame, model: dict, horizon: int) -> DataFrame:
    """Forecast rows for each frame (field, t, w) that arrives: predicts through missing days, then updates.

    A field's state is kept with those of the last L days and their frames. A frame up to L - 1 days late is put into
    its own day and the days since are filtered anew (late); an older one is only reported (refused, lead 0). The state
    is (L k)^2 numbers for each of L days, so vectors should be in a small subspace.
    """
    depth = Lifted(model).L

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lift = Lifted(model)
        ring: dict = pickle.loads(state.get[0]) if state.exists else {}  # t: (z, p after the day, its frame)
        rows = []
        for f in frames:
            for t, w in sorted(zip(f["t"], f["w"], strict=True), key=lambda x: x[0]):
                t, y = int(t), _vector(w)
                if y is None:
                    continue
                last, late = max(ring, default=t), False
                if not ring:
                    ring[t] = (*lift.start(y), y)
                elif t > last:
                    z, p, _ = ring[last]
                    for day in range(last + 1, t + 1):
                        frame = y if day == t else None
                        z, p, _ = lift.step(z, p, None, frame, None)
                        ring[day] = (z, p, frame)
                elif t - 1 in ring and t > last - depth:
                    late = True
                    kept = {d: x[2] for d, x in ring.items()} | {t: y}
                    z, p, _ = ring[t - 1]
                    for day in range(t, last + 1):
                        z, p, _ = lift.step(z, p, None, kept.get(day), None)
                        ring[day] = (z, p, kept.get(day))
                else:
                    rows.append((key[0], t, 0, y.tolist(), True, True))
                    continue
                now = max(ring)
                ring = {d: x for d, x in ring.items() if d >= now - depth}
                z, p, _ = ring[now]
                for h in range(1, horizon + 1):
                    z, p = lift.predict(z, p, None)
                    rows.append((key[0], now, h, z[: lift.k].tolist(), late, False))
        state.update((pickle.dumps(ring),))
        yield pd.DataFrame(rows, columns=["field", "t", "lead", "w", "late", "refused"])

    return stream.groupBy("field").applyInPandasWithState(step, OUT, "ring binary", "append", "NoTimeout")


LIVE = "field long, t long, lead int, w array<double>, kind string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


class LiveFilter(StatefulProcessor):
    """The lifted filter of one field, fed by frames (t: day, w). State: a map from the last days to their state, covariance and frame,
    and the newest day. A timer for each day after the newest lets the filter go on where no frame comes."""

    def __init__(self, model: dict, horizon: int, silent: int):
        self.model, self.horizon, self.silent = model, horizon, silent

    def init(self, handle) -> None:
        self.handle, self.lift = handle, Lifted(self.model)
        self.days = handle.getMapState("days", "t long", "z array<double>, p array<double>, y array<double>")
        self.newest = handle.getValueState("newest", "t long, seen long")

    def _at(self, t: int):
        z, p, y = self.days.getValue((t,))
        return np.array(z), np.array(p).reshape(len(z), -1), None if y is None else np.array(y)

    def _keep(self, t: int, z: np.ndarray, p: np.ndarray, y: np.ndarray | None) -> None:
        self.days.updateValue((t,), (z.tolist(), p.ravel().tolist(), None if y is None else y.tolist()))
        if self.days.containsKey((t - self.lift.L - 1,)):
            self.days.removeKey((t - self.lift.L - 1,))

    def _through(self, first: int, last: int, frames: dict) -> None:
        """Filters the days from first on, after the state of the day before, with the frames that there are."""
        z, p, _ = self._at(first - 1)
        for t in range(first, last + 1):
            z, p, _ = self.lift.step(z, p, None, frames.get(t), None)
            self._keep(t, z, p, frames.get(t))

    def _forecasts(self, field, t: int, kind: str) -> list[tuple]:
        z, p, _ = self._at(t)
        out = []
        for h in range(1, self.horizon + 1):
            z, p = self.lift.predict(z, p, None)
            out.append((field, t, h, z[: self.lift.k].tolist(), kind))
        return out

    def _watch(self, t: int) -> None:
        """A timer for the end of the day after t."""
        for x in list(self.handle.listTimers()):
            self.handle.deleteTimer(x)
        self.handle.registerTimer((t + 2) * _DAY_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        field, out = key[0], []
        frames = [(int(t), y) for f in rows for t, w in zip(f["t"], f["w"], strict=True) if (y := _vector(w)) is not None]
        now, seen = self.newest.get() if self.newest.exists() else (None, None)
        for t, y in sorted(frames, key=lambda x: x[0]):
            if now is None:
                self._keep(t, *self.lift.start(y), y)
                now = seen = t
                out += self._forecasts(field, t, "frame")
            elif t > now:
                self._through(now + 1, t, {t: y})
                now, seen = t, max(seen, t)
                out += self._forecasts(field, t, "frame")
            elif t > now - self.lift.L and self.days.containsKey((t - 1,)):
                known = {d: self._at(d)[2] for d in range(t, now + 1)} | {t: y}
                self._through(t, now, {d: x for d, x in known.items() if x is not None})
                seen = max(seen, t)
                out += self._forecasts(field, now, "late")
            else:
                out.append((field, t, 0, y.tolist(), "refused"))
        if now is not None:
            self.newest.update((now, seen))
            self._watch(now)
        yield pd.DataFrame(out, columns=["field", "t", "lead", "w", "kind"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (now, seen), out = self.newest.get(), []
        # All days that ended without a frame by now, so many after the last frame at most.
        last = min(timerValues.getCurrentWatermarkInMs() // _DAY_MS - 1, seen + self.silent)
        while now < last:
            now += 1
            self._through(now, now, {})
            out += self._forecasts(key[0], now, "silent")
        self.newest.update((now, seen))
        if now < seen + self.silent:
            self._watch(now)
        yield pd.DataFrame(out, columns=["field", "t", "lead", "w", "kind"])

    def close(self) -> None:
        pass


def live_filter(stream: DataFrame, model: dict, horizon: int, delay: str = "3 days", silent: int = 7) -> DataFrame:
    """Forecasts of fields whose frames (field, ts, w) arrive in any order: field, t (day), lead, w, kind.

    kind: "frame" for forecasts from a frame's day; "late" where a frame of one of the last L days was put into its place and the
    days since filtered anew; "silent" from a day that ended by event time without a frame, for `silent` days after the
    last frame at most; "refused" (lead 0) for a frame too old for that, given out as it is. Rows later than the watermark
    are dropped by Spark. Run it with the RocksDB state store.
    """
    day = F.unix_date(F.col("ts").cast("date")).cast("long")
    rows = stream.withWatermark("ts", delay).select("field", "ts", day.alias("t"), "w")
    return rows.groupBy("field").transformWithStateInPandas(LiveFilter(model, horizon, silent), LIVE, "append", "EventTime")


def chained_scores(daily: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("field",)) -> DataFrame:
    """(keys, day, pred, value): yesterday's daily mean as the forecast of each day, met with the day's own when its window closes; null
    where the day has passed without one.

    daily, truth: (keys, window, value) by tumbling days of watermarked streams, so that aggregation and join are two stateful
    steps of one query, and the join lets go of a day by the watermark that the aggregation passes on.
    """
    f = daily.select(*keys, F.window_time("window").alias("at"), F.col("value").alias("pred")).alias("f")
    t = truth.select(*[F.col(k).alias(f"own_{k}") for k in keys], F.window_time("window").alias("seen"), "value").alias("t")
    on = F.expr(" AND ".join([*[f"f.{k} = t.own_{k}" for k in keys], "t.seen = f.at + INTERVAL 1 DAY"]))
    both = f.join(t, on, "leftOuter")
    return both.select(*[F.col(f"f.{k}") for k in keys], F.date_add(F.col("f.at").cast("date"), 1).alias("day"), "pred", "value")


@contextmanager
def rocks(spark) -> Iterator[None]:
    """The RocksDB state store, which stateful processors need, while a stream is started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns its rows; for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now into a Parquet table in the folder that driver and executors share."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
