"""Streams of order events: silence, expiry, answers remembered once, and versions that win."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of events with no silence of gap between them; a run is emitted when the watermark passes its end."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def windowed_counts(events: DataFrame, kind: str = "event_type", at: str = "ts", size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), kind, "n")


def once(events: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key inside the watermark's span."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


class PendingExpiry(StatefulProcessor):
    """Per order: 'expired' when nothing has happened for so long; any later event starts it anew.

    Input: key, ts, state (pending, received or closed). Output: key, outcome, at."""

    def __init__(self, days: int = 60):
        self.span = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values("ts")
        newest = frame.iloc[-1]
        at, state = int(newest["ts"].timestamp() * 1000), newest["state"]
        known = self.last.get() if self.last.exists() else None
        if known is None or at >= known[0]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.last.update((at, state))
            if state == "pending":
                self.handle.registerTimer(at + self.span)
        if state != "pending":
            yield pd.DataFrame({"key": [key[0]], "outcome": [state], "at": [pd.Timestamp(at, unit="ms")]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "outcome": ["expired"], "at": [pd.Timestamp(at, unit="ms")]})

    def close(self) -> None:
        pass


def expiring(events: DataFrame, days: int = 60, late: str = "1 day") -> DataFrame:
    """events: key, ts, state. Needs the RocksDB state store."""
    keyed = events.withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(PendingExpiry(days), "key long, outcome string, at timestamp", "Append", "EventTime")


def ask_again(answers: DataFrame, days: int = 7, late: str = "1 hour") -> DataFrame:
    """key, due: a question that was answered with no is due again so many days later, unless another answer came since.

    answers: key, ts, answer (no, yes, or asked where the question was put again). A key's state is its newest answer; it
    goes when its time is up, so the state holds the last days' keys only."""
    span = days * 86_400_000

    def step(key, batches, state):
        if state.hasTimedOut:
            at, waits = state.get
            state.remove()
            if waits:
                yield pd.DataFrame({"key": [key[0]], "due": [pd.Timestamp(at + span, unit="ms")]})
            return
        newest = pd.concat(list(batches)).sort_values("ts").iloc[-1]
        at = int(newest["ts"].timestamp() * 1000)
        if not state.exists or at >= state.get[0]:
            state.update((at, bool(newest["answer"] == "no")))
        # an answer that is older than the watermark by its whole time is due at once
        state.setTimeoutTimestamp(max(state.get[0] + span, state.getCurrentWatermarkMs() + 1))

    keyed = answers.withWatermark("ts", late).groupBy("key")
    return keyed.applyInPandasWithState(step, "key long, due timestamp", "at long, waits boolean", "append", "EventTimeTimeout")


def versioned_sink(path: str, keys: list[str], version: str):
    """A foreachBatch function that keeps the greatest version of each key in a Parquet table, one folder for each
    batch; replays of a batch overwrite their own folder, and readers take the newest one."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = batch
        if number > 0:
            state = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}").unionByName(batch)
        rest = [c for c in batch.columns if c not in (*keys, version)]
        best = state.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("b")).select(*keys, "b.*").select(*batch.columns)
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
