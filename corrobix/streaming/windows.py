"""Structured Streaming variants of the evidence cube, the per-second de-duplication and the daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """day, site_id, device_type, n over tumbling days; rows later than the delay are dropped by the watermark."""
    w = stream.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 day"), "site_id", "device_type").agg(F.count("*").alias("n"))
    return w.select(F.to_date("window.start").alias("day"), "site_id", "device_type", "n")


def once_a_second(stream: DataFrame, keys: tuple[str, ...], delay: str = "10 seconds") -> DataFrame:
    """First row of each key and second; state goes with the watermark."""
    return stream.withColumn("timestamp", F.date_trunc("second", "timestamp")).withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([*keys, "timestamp"])
