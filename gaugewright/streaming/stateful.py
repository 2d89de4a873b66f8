"""Conversations and drift from streams, with state of their own: open conversations close by a timer, and a gate remembers past windows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import new_path

#: The store that state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURN = "turn long, role string, text string"


def _millis(ts: Any) -> int:
    return int(pd.Timestamp(ts).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(ts).tzinfo is None else int(pd.Timestamp(ts).timestamp() * 1000)


def _moment(millis: int) -> datetime:
    return datetime.fromtimestamp(millis / 1000, timezone.utc)


class _Assembler(StatefulProcessor):
    """Of a key: the sessions that are open, each with its first and last time, and their turns. A turn joins the sessions that it lies within the
    gap of, which may make one of two; when the watermark has passed a session's end it is given out and forgotten. The state takes a few calls
    a key in each batch, not a turn: calls cost a millisecond or so each."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "at long, turn long, role string, text string")

    def _sessions(self, rows: list[tuple]) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        for row in sorted(rows, key=lambda r: r[0]):
            if out and row[0] - out[-1][-1][0] < self.gap:
                out[-1].append(row)
            else:
                out.append([row])
        return out

    def _wait(self, sessions: list[list[tuple]]) -> None:
        """One timer, at the end of the session that ends first."""
        first = min((s[-1][0] + self.gap for s in sessions), default=None)
        there = list(self.handle.listTimers())
        for old in there:
            if old != first:
                self.handle.deleteTimer(old)
        if first is not None and first not in there:
            self.handle.registerTimer(first)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002 - names are Spark's
        new: list[tuple] = []
        for pdf in rows:
            new += [(_millis(ts), int(turn), role or "", text or "") for ts, turn, role, text in zip(pdf["ts_"], pdf["turn_"], pdf["role_"], pdf["text_"], strict=True)]
        held = [tuple(row) for row in self.turns.get()] if self.turns.exists() else []
        self.turns.appendList(new)
        self._wait(self._sessions(held + new))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out, left = [], []
        for session in self._sessions([tuple(row) for row in self.turns.get()]):
            if session[-1][0] + self.gap <= now:
                ordered = sorted(row[1:] for row in session)
                out.append((key[0], _moment(session[0][0]), _moment(session[-1][0] + self.gap), [{"turn": t, "role": r, "text": x} for t, r, x in ordered]))
            else:
                left.append(session)
        if left:
            self.turns.put([row for session in left for row in session])
        else:
            self.turns.clear()
        self._wait(left)
        if out:
            yield pd.DataFrame(out, columns=["key_", "start", "end", "turns"])

    def close(self) -> None:
        pass


def assembled_conversations(stream: DataFrame, ts: str, key: str, order: str, role: str, text: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``key``, ``start``, ``end`` and ``turns`` (turn, role, text; by turn) of conversations: the turns of a key less than ``gap`` apart. Turns may come in
    any order and ``late``; those that come after the watermark has passed them are left out, as Spark's own windows do.

    State holds the turns of open conversations alone, a list for each key that is read and written as one; one timer a key, at the first end,
    gives out all its conversations that the watermark has passed and clears them. Null roles and texts are empty, null keys are a key like any other, repeated turns
    stay. Needs the state store PROVIDER (``spark.sql.streaming.stateStore.providerClass``)."""
    gap_ms = int(pd.Timedelta(gap).total_seconds() * 1000)
    kind = stream.schema[key].dataType.simpleString()
    picked = stream.select(F.col(key).alias("key_"), F.col(ts).cast("timestamp").alias("ts_"), F.col(order).cast("long").alias("turn_"), F.col(role).alias("role_"), F.col(text).alias("text_"))
    out = picked.withWatermark("ts_", late).groupBy("key_").transformWithStateInPandas(
        _Assembler(gap_ms), f"key_ {kind}, start timestamp, end timestamp, turns array<struct<{TURN.replace(' ', ': ').replace(',:', ',')}>>", "append", "EventTime"
    )
    return out.withColumnRenamed("key_", key)


class _Gate(StatefulProcessor):
    """Of a slice: the last windows' means, and whether the alarm is on."""

    def __init__(self, baseline: float, tolerance: float, patience: int):
        self.baseline, self.tolerance, self.patience = baseline, tolerance, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "low int, alarm boolean, seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        windows = pd.concat(list(rows)).sort_values("start_")
        low, alarm, seen = self.run.get() if self.run.exists() else (0, False, -1)
        out = []
        for start, n, score in zip(windows["start_"], windows["n_"], windows["score_"], strict=True):
            at = _millis(start)
            if at <= seen:
                continue
            seen = at
            if pd.isna(score):  # a window without a score says nothing
                continue
            low = low + 1 if score < self.baseline - self.tolerance else 0
            if (low >= self.patience) != alarm:
                alarm = not alarm
                out.append((key[0], _moment(at), int(n), float(score), "alarm" if alarm else "cleared"))
        self.run.update((int(low), bool(alarm), int(seen)))
        if out:
            yield pd.DataFrame(out, columns=["slice_", "start", "n", "score", "state"])

    def close(self) -> None:
        pass


def drift_alarms(stream: DataFrame, ts: str, score: str, by: str, baseline: float, tolerance: float, patience: int = 2, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``by``, ``start``, ``n``, ``score`` and ``state`` of the windows with which a slice's alarm goes on (``patience`` windows in a row whose mean lies below
    ``baseline`` by more than ``tolerance``) or is cleared (one that does not). Windows are judged in their order when the watermark has passed
    them; those without a score are passed over. State is a few numbers a slice."""
    kind = stream.schema[by].dataType.simpleString()
    valid = F.when(~F.isnan(F.col(score).cast("double")), F.col(score))
    means = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), F.col(by).alias("slice_")).agg(F.count("*").alias("n_"), F.avg(valid).alias("score_"))
    means = means.select("slice_", F.col("w.start").alias("start_"), "n_", "score_")
    out = means.groupBy("slice_").transformWithStateInPandas(_Gate(baseline, tolerance, patience), f"slice_ {kind}, start timestamp, n long, score double, state string", "append", "None")
    return out.withColumnRenamed("slice_", by)


def run_once(spark: SparkSession, result: DataFrame, label: str) -> DataFrame:
    """Run a streaming result over all that its sources hold now, into the shared folder, and read it: what a scheduled job does with a
    checkpoint of its own. Conversations and windows that the watermark has not passed stay in the state."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before, out = spark.conf.get(key), new_path(spark, label)
    spark.conf.set(key, PROVIDER)
    try:
        stream = result.writeStream.outputMode("append").option("checkpointLocation", new_path(spark, f"{label}-state"))
        query = stream.trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(result.schema).parquet(out)
