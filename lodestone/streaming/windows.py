"""Event-time windows over streams: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time_col: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts per window and key; rows later than `late` are left out on streams."""
    t = F.col(time_col).cast("timestamp")
    return events.withColumn(time_col, t).withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
