"""Joins of two streams by key and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.streaming.sessions import with_event_time


def followed(first: DataFrame, then: DataFrame, key: str, within: str, late: str = "2 hours") -> DataFrame:
    """first (key, ts, id), then (key, ts, id) -> key, first_id, first_ts, then_id, then_ts: what follows a row of first within a time, ends included.

    Rows of first that nothing follows come with nulls; of streams, once the watermark is past their time. Rows that wait are
    kept for `within` and `late` only. Of tables the same rows come, all at once.
    """
    side = lambda df, name: with_event_time(df).select(F.col(key).alias(f"{name}_{key}"), F.col("ts").alias(f"{name}_ts"), F.col("id").alias(f"{name}_id"))
    a, b = side(first, "first"), side(then, "then")
    if first.isStreaming or then.isStreaming:
        a, b = a.withWatermark("first_ts", late), b.withWatermark("then_ts", late)
    near = F.expr(f"first_{key} = then_{key} AND then_ts >= first_ts AND then_ts <= first_ts + INTERVAL {within}")
    return a.join(b, near, "leftOuter").select(F.col(f"first_{key}").alias(key), "first_id", "first_ts", "then_id", "then_ts")
