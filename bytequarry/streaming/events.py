"""Extension (the formats' tools have no streams): event-time windows over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by user and window, final once the watermark has passed it."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", width))
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("window.start").alias("hour"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, parted by gaps."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_copies(rows: DataFrame, key: str = "digest", late: str = "1 hour") -> DataFrame:
    """Rows less later copies of a key within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
