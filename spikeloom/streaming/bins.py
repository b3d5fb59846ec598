"""The bin builder over a stream of events: counts by neuron and window, with late events up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bins(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """neuron, start, y of each window that has events; windows close once the watermark has passed them."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    counts = stamped.groupBy(F.col("user_id").alias("neuron"), F.window("at", width).alias("w")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return counts.select("neuron", F.col("w.start").alias("start"), "y")
