"""Streaming twin of the bin counts (an extension: the batch pipelines don't need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bin_counts(events: DataFrame, key: str, ts: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows of a stream in tumbling windows of each key; rows later than ``late`` are left out of closed windows."""
    instants = events.withColumn("_at", F.col(ts).cast("timestamp"))
    counts = instants.withWatermark("_at", late).groupBy(F.window("_at", width), F.col(key)).agg(F.count(F.lit(1)).alias("demand"))
    return counts.select(key, F.col("window.start").cast("timestamp_ntz").alias("bin"), "demand")
