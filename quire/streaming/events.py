"""Event streams: windows with late data, sessions, and a status machine, for batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Event files of a folder as a stream, a few files a trigger."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): events in tumbling windows; those later than the watermark are dropped by a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, finish, n): sessions of users that end after a gap."""
    return events.withWatermark("ts", gap).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("finish"), "n")


def first_of_each(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """A stream without repeated event ids within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
