"""Structured Streaming forms of the event queries; every function takes a batch or a streaming DataFrame alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, length: str, watermark: str | None = None) -> DataFrame:
    """``(window_start, event_type, n, total)`` per tumbling window; with a watermark late rows beyond it are dropped by the stream."""
    timed = events.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    grouped = timed.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """``(user_id, started, ended, n)`` per session of a user."""
    timed = events.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    if watermark:
        timed = timed.withWatermark("ts", watermark)
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files as they arrive in a folder: input of the text parsers in ``sources.text``."""
    return spark.readStream.format("text").load(path)
