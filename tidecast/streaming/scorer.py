"""Streaming scorer: events summed to the sampling grid behind a watermark, joined with a static forecast, and flagged.

Beyond what a batch library offers: the forecast table is computed ahead, so that the stream only needs a window and a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.functions.durations import micros


def on_grid(stream: DataFrame, ts: str, step: str | int, aggregate: Column, keys: Sequence[str] = (), lateness: str = "1 hour") -> DataFrame:
    """ds and y by tumbling windows of one step; rows later than ``lateness`` are dropped once their window is out."""
    size = f"{micros(step)} microseconds"
    watched = stream.withWatermark("_event_time", lateness) if "_event_time" in stream.columns else stream.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", lateness)
    windows = watched.groupBy(F.window("_event_time", size).alias("_w"), *keys).agg(aggregate.alias("y"))
    return windows.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("ds"), "y")


def flag(windows: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The windows with their forecast and whether they are beyond the observed bounds."""
    joined = windows.join(forecast.select(*keys, "ds", "yhat", "observed_lower", "observed_upper"), [*keys, "ds"])
    return joined.withColumn("is_anomaly", (F.col("y") < F.col("observed_lower")) | (F.col("y") > F.col("observed_upper")))
