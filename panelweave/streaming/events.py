"""Task events as streams: idempotent adds and metrics by window. The same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 day"
FOR_EVER = "36500 days"
WINDOW = "1 day"
KINDS = ("add", "claim", "complete", "fail", "reopen")


def unique_adds(events: DataFrame, late: str = FOR_EVER) -> DataFrame:
    """Streaming adds, each lane's once; ts is a timestamp.

    An add may be repeated at any time, so by default a lane is never forgotten: state grows
    with the number of lanes. A shorter `late` bounds it, and lets a later repeat through.
    """
    return events.filter("kind = 'add'").withWatermark("ts", late).dropDuplicatesWithinWatermark(["lane"])


def window_metrics(events: DataFrame, late: str = LATE, width: str = WINDOW) -> DataFrame:
    """Counts by kind and tumbling window; later events than the watermark are dropped from a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", width).alias("w")).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS))
    return counts.select(F.col("w.start").alias("start"), *(f"n_{k}" for k in KINDS))
