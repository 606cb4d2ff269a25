"""Operators whose state lives in the engine's state store: per key, with event-time timers, changed keys written only.

Rows of a key may come in any order within a micro-batch, and batches may cut the stream anywhere, as long as a key's later batches
hold its later rows. Then the output is that of one pass over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.track import smooth_steps
from . import carry

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocks(spark: SparkSession):
    """Keyed state with timers needs this provider; a query keeps the settings it was started with."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def run_parts(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write every micro-batch of a stateful stream as its own part; a batch that runs again replaces its part."""
    with _rocks(stream.sparkSession):
        return carry.run_batches(stream, lambda b, i: carry.write_part(b, path, i), checkpoint, trigger)


def _frame(chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True)


# ---- marker lifecycle ------------------------------------------------------------------

TRANSITION = "status string, at_ms bigint"


def marker_steps(missed_ms: int, dim_ms: int, cull_ms: int, forget_ms: int | None) -> Callable[[bool, bool], list[tuple[int, str]]]:
    """(milliseconds after the last sight, status) in order, for a marker that is shown or not, at its last stop or not."""

    def steps(shown: bool, at_last: bool) -> list[tuple[int, str]]:
        if not shown:
            return [(missed_ms, "removed")]
        found = [(missed_ms, "fading")] if at_last else [(dim_ms, "stale-dim"), (cull_ms, "fading")]
        return found + ([(forget_ms, "removed")] if forget_ms is not None else [])

    return steps


class Markers(StatefulProcessor):
    """Status of one marker: the newest sight is the state, and a timer stands at its next change."""

    def __init__(self, steps):
        self.steps = steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("marker", "seen bigint, tie bigint, shown boolean, at_last boolean, done int, timer bigint")

    def _advance(self, key, marker, now: int, out: list) -> list | None:
        """Write the changes due by ``now``; the marker is None once removed."""
        seen, tie, shown, at_last, done, timer = marker
        todo = self.steps(shown, at_last)
        while done < len(todo) and seen + todo[done][0] + 1 <= now:
            out.append((*key, todo[done][1], seen + todo[done][0] + 1))
            done += 1
            if todo[done - 1][1] == "removed":
                return None
        return [seen, tie, shown, at_last, done, timer]

    def _keep(self, marker: list | None) -> None:
        """Store the marker, with a timer at its next change unless an earlier one is still to come."""
        if marker is None:
            self.state.clear()
            return
        seen, tie, shown, at_last, done, timer = marker
        todo = self.steps(shown, at_last)
        if done < len(todo) and timer < 0:
            timer = seen + todo[done][0] + 1
            self.handle.registerTimer(timer)
        self.state.update((seen, tie, shown, at_last, done, timer))

    def _load(self) -> list | None:
        if not self.state.exists():
            return None
        return list(self.state.get())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        marker, out = self._load(), []
        timer = marker[5] if marker else -1
        sights = _frame(rows).sort_values(["ms", "tie"], kind="stable")
        for ms, tie, shown, at_last in zip(*(sights[c].tolist() for c in ("ms", "tie", "shown", "at_last")), strict=True):
            if marker and (ms, tie) <= (marker[0], marker[1]):
                continue
            if marker:
                marker = self._advance(key, marker, ms, out)
            if not marker or marker[4]:
                out.append((*key, "active", ms))
            marker = [ms, tie, bool(shown), bool(at_last), 0, timer]
        # a timer that was set for an earlier sight comes too early, and is set anew then
        self._keep(marker)
        yield pd.DataFrame(out, columns=["k", "status", "at_ms"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        marker, out = self._load(), []
        if marker and marker[5] == expiredTimerInfo.getExpiryTimeInMs():
            marker[5] = -1
            self._keep(self._advance(key, marker, timerValues.getCurrentWatermarkInMs(), out))
        yield pd.DataFrame(out, columns=["k", "status", "at_ms"])

    def close(self) -> None:
        pass


def marker_stream(sights: DataFrame, path: str, checkpoint: str, shown: Column, at_last_stop: Column, missed_seconds: float = 30, dim_seconds: float = 120,
                  cull_seconds: float = 600, forget_seconds: float | None = None, watermark: str = "0 seconds", trip: str = "trip_id", ts: str = "ts",
                  tie: str = "arrival_id", trigger: dict | None = None) -> StreamingQuery:
    """Status changes of markers as time passes: trip, status, at_ms.

    A sight makes a marker active. Without a new sight, a marker that is filtered out (not ``shown``) is removed once a cycle missed it,
    one at its last stop fades then; others dim, fade and, if ``forget_seconds`` is given, go. Changes that no row announces are made by
    timers on the watermark, so they need no further row of the trip; the state of a removed marker is cleared. Sights older
    than the watermark, or than the newest of their trip in an earlier batch, come too late and change nothing.
    """
    steps = marker_steps(*(int(s * 1000) for s in (missed_seconds, dim_seconds, cull_seconds)), None if forget_seconds is None else int(forget_seconds * 1000))
    rows = sights.withWatermark(ts, watermark).select(F.col(trip).alias("k"), F.col(ts).alias("seen"), F.unix_millis(ts).alias("ms"), F.col(tie).cast("bigint").alias("tie"),
                                                      F.coalesce(shown, F.lit(False)).alias("shown"), F.coalesce(at_last_stop, F.lit(False)).alias("at_last"))
    rows = rows.filter(F.col("k").isNotNull() & F.col("seen").isNotNull())
    kind = rows.schema["k"].dataType.simpleString()
    made = rows.groupBy("k").transformWithStateInPandas(Markers(steps), f"k {kind}, {TRANSITION}", "Append", "EventTime")
    return run_parts(made.withColumnRenamed("k", trip), path, checkpoint, trigger)


def marker_changes(sights: DataFrame, now_ms: Column, shown: Column, at_last_stop: Column, missed_seconds: float = 30, dim_seconds: float = 120,
                   cull_seconds: float = 600, forget_seconds: float | None = None, trip: str = "trip_id", ts: str = "ts", tie: str = "arrival_id") -> DataFrame:
    """Batch form of ``marker_stream``: the changes of every trip up to ``now_ms``."""
    order = Window.partitionBy(trip).orderBy("ms", "tie")
    rows = sights.filter(F.col(trip).isNotNull() & F.col(ts).isNotNull()).select(
        trip, F.unix_millis(ts).alias("ms"), F.col(tie).cast("bigint").alias("tie"), F.coalesce(shown, F.lit(False)).alias("shown"), F.coalesce(at_last_stop, F.lit(False)).alias("at_last"))

    def step(seconds: float, status: str) -> Column:
        after = F.col("ms") + F.lit(int(seconds * 1000) + 1)
        return F.when(after <= F.coalesce("next", now_ms), F.struct(F.lit(status).alias("status"), after.alias("at_ms")))

    gone = [step(forget_seconds, "removed")] if forget_seconds is not None else []
    changes = F.when(~F.col("shown"), F.array(step(missed_seconds, "removed"))).when(F.col("at_last"), F.array(step(missed_seconds, "fading"), *gone)).otherwise(
        F.array(step(dim_seconds, "stale-dim"), step(cull_seconds, "fading"), *gone))
    made = rows.withColumn("next", F.lead("ms").over(order)).withColumn("changes", F.array_compact(changes))
    revived = F.coalesce(F.lag(F.size("changes")).over(order), F.lit(1)) > 0
    made = made.withColumn("changes", F.when(revived, F.concat(F.array(F.struct(F.lit("active").alias("status"), F.col("ms").alias("at_ms"))), "changes")).otherwise(F.col("changes")))
    return made.select(trip, F.inline("changes"))


def marker_statuses(changes: DataFrame, trip: str = "trip_id") -> DataFrame:
    """The newest status per trip."""
    return changes.groupBy(trip).agg(F.max_by("status", "at_ms").alias("status"))


# ---- smoothing -------------------------------------------------------------------------


class Smoother(StatefulProcessor):
    """The filter's state per key: arclength, speed, acceleration, time."""

    def __init__(self, settings: tuple):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", "s double, v double, a double, t double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        points = _frame(rows).sort_values("o", kind="stable")
        before = tuple(self.state.get()) if self.state.exists() else None
        made, after = smooth_steps(points["z"].tolist(), points["ms"].tolist(), before, *self.settings)
        self.state.update(tuple(float(x) for x in after))
        s, v, a, again = zip(*made, strict=True)
        yield pd.DataFrame({"k": [key[0]] * len(made), "o": points["o"].to_numpy(), "s": s, "v": v, "a": a, "restarted": again})

    def close(self) -> None:
        pass


def smooth_stream(points: DataFrame, path: str, checkpoint: str, key: str, order: str, measurement: str, time_ms: str, alpha: float = 0.35, beta: float = 0.15,
                  gamma: float = 0.05, vmax: float = 20.0, amax: float = 1.0, jump: float = 5000.0, trigger: dict | None = None) -> StreamingQuery:
    """Streaming form of ``track.smooth``: each measurement is smoothed from the state its key has in the state store.

    A jump restarts the filter, as in the batch form. Rows without key or measurement are left out; rows that come in a later
    batch than rows that follow them are taken as measured then.
    """
    rows = points.filter(F.col(key).isNotNull() & F.col(measurement).isNotNull()).select(
        F.col(key).alias("k"), F.col(order).alias("o"), F.col(measurement).cast("double").alias("z"), F.col(time_ms).cast("bigint").alias("ms"))
    types = [rows.schema[c].dataType.simpleString() for c in ("k", "o")]
    made = rows.groupBy("k").transformWithStateInPandas(Smoother((alpha, beta, gamma, vmax, amax, jump)),
                                                        f"k {types[0]}, o {types[1]}, s double, v double, a double, restarted boolean", "Append", "None")
    return run_parts(made.withColumnsRenamed({"k": key, "o": order}), path, checkpoint, trigger)
