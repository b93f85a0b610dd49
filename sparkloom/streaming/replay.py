"""Replayable results, and event-time counts as an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix(df: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows in the order of all columns, with ``complete``: a prefix proves nothing about what follows."""
    rows = df.orderBy(*df.columns).limit(k + 1)
    total = rows.agg((F.count("*") <= k).alias("complete"))
    return df.orderBy(*df.columns).limit(k).crossJoin(F.broadcast(total))


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of a batch or a stream of events; rows later than ``late`` are dropped from streams."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    found = timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).alias("total"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))
