"""Event-time windows. Each works on a batch and, with a watermark, on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _late(df: DataFrame, delay: str | None, on: str) -> DataFrame:
    return df.withWatermark(on, delay) if delay else df


def _start(window: Column) -> Column:
    return F.date_format(window["start"], _FORMAT).alias("start")


def tumbling_counts(events: DataFrame, size: str, delay: str | None = None) -> DataFrame:
    """Rows a window and event type."""
    return _late(events, delay, "ts").groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(_start(F.col("w")), "event_type", "n")


def sliding_counts(events: DataFrame, size: str, slide: str, delay: str | None = None) -> DataFrame:
    """Rows an overlapping window and event type."""
    return _late(events, delay, "ts").groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(_start(F.col("w")), "event_type", "n")


def session_totals(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    """Rows and the sum of value of each user's sessions: stretches without a gap of that length."""
    grouped = _late(events, delay, "ts").groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", _start(F.col("w")), "n", "total")


def first_of_each(events: DataFrame, key: list[str], delay: str) -> DataFrame:
    """The first row of each key within the watermark, for streams with repeated deliveries."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)
