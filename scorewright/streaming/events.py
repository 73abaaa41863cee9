"""Structured Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event files put into a folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, if its copies come within the watermark; state older than that is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def windowed_scores(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean value of each event type and window of time."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "mean_value")


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends to Parquet with exactly-once files and ends when all input is read."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
