"""Log metrics over a stream: counts in time windows and sessions. An extension; the batch operators are in operators.log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of events as they arrive."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, kind, count, total) for each window that the watermark has passed."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("count"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), kind, "count", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "30 minutes", time: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, start, end, count): runs of a user's events with no pause of ``gap`` or more."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("count"))
    return counted.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "count")
