"""Streaming sums of a measure by day; an extension, since scores are additive over records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Works on a stream and on a table: day, event_type, n, total; a stream drops what is later than `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))
