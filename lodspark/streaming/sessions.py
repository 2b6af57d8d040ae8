"""Sessions: runs of events of a key without a long gap, in batches and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """`key, first_ts, last_ts, n` of each session. With `late`, a watermark lets a stream close sessions and drop what comes later."""
    if late:
        events = events.withWatermark(ts, late)
    grouped = events.groupBy(key, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(ts).alias("n")).drop("w")
