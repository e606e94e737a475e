"""Profiles over streams: an extension, as the engine's own dataflow has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "1 hour", window: str = "1 hour", group: str = "event_type") -> DataFrame:
    """Count and sum of values of each group in tumbling windows; rows later than ``late`` are left out."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, window).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), group, "n", "total")
