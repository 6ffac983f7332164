"""Events that arrive as files: typed, counted by day as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENTS


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of events, read once each as they appear."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, event_type, n) of a stream of events, with a watermark after which a day is final."""
    timed = events.withColumn("ts", F.col("date").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("date").alias("day"), "event_type", "n")
