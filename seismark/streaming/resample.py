"""Tumbling means on a stream of readings: the streaming run of the resampling operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resample_stream(readings: DataFrame, metric: str, every: str = "5 minutes", late: str = "10 minutes", ts: str = "ts", value: str = "value") -> DataFrame:
    """Mean per metric and window, emitted once the watermark passes; state is one partial mean per open window."""
    w = F.window(ts, every)
    g = readings.withWatermark(ts, late).groupBy(metric, w).agg(F.avg(value).alias("value"))
    return g.select(metric, F.col("window.start").alias("start_ts"), "value")
