"""Continuous evaluation: windowed means of scored traces, conversations from turns, and a drift gate. An extension of the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.aggregate import nan_mean


def windowed_means(stream: DataFrame, ts: str, score: str, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """NaN-mean and count of a score per time window (tumbling, or sliding with ``slide``) and slice; rows later than ``late`` are left out."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    grouped = stream.withWatermark(ts, late).groupBy(w.alias("w"), *(by or []))
    return grouped.agg(F.count("*").alias("n"), nan_mean(score).alias("score")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "n", "score")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Turn counts of the sessions of each key: turns less than ``gap`` apart belong together."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return grouped.agg(F.count("*").alias("turns")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def conversations(stream: DataFrame, ts: str, key: str, order: str, role: str, text: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Conversations from turns: those of a key less than ``gap`` apart, in their order. In append mode one is given out when the
    watermark has passed its end."""
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    held = grouped.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")))).alias("turns"))
    return held.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "turns")


def drift_gate(means: DataFrame, baseline: float, tolerance: float, alarm: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch's windows whose score has fallen below the baseline by more than the tolerance to ``alarm``."""
    return means.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, epoch: alarm(df.where(F.col("score") < baseline - tolerance), epoch)).start()
