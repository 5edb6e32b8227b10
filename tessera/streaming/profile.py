"""An incremental numeric profile of a stream, by event type and hour (no counterpart in batch reports)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_profile(events: DataFrame, *, time: str = "ts", by: str = "event_type", value: str = "value", late: str = "1 hour") -> DataFrame:
    """Count, minimum, maximum and sums of ``value`` in each hour; events later than ``late`` are dropped, and
    the state of an hour goes when the watermark passes it. Works on streams and tables alike."""
    number = F.col(value)
    windowed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, "1 hour").alias("hour"), by)
    found = windowed.agg(F.count(number).alias("n"), F.min(number).alias("min"), F.max(number).alias("max"), F.avg(number).alias("mean"), F.stddev_samp(number).alias("std"))
    return found.select(F.col("hour.start").cast(events.schema[time].dataType).alias("hour"), by, "n", "min", "max", "mean", "std")
