"""Streams of events: counts in windows, and repeats left out, with bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, so many at a time, with ``ts`` as an event time."""
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of each window; rows later than ``late`` are left out and old windows leave the state."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, user_id, n) of each user's sessions, told by a gap."""
    counts = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("session_window.start").alias("start"), "user_id", "n")


def first_within(events: DataFrame, keys: list[str], late: str = "30 seconds") -> DataFrame:
    """The first of repeated rows of a key; a key leaves the state once ``late`` has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
