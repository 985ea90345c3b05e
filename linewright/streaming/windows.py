"""Time windows over event streams (an extension: the line operators themselves read whole files)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, length: str, late: str, by: str = "event_type", ts: str = "ts", value: str = "value") -> DataFrame:
    """Count and sum of each kind in tumbling windows. A stream forgets a window once events are `late` past it."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, length).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
