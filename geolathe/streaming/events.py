"""Streams: an event feed counted by window and cell, late rows cut off by a watermark. An extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A file stream over Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total: works on a batch and on a stream alike."""
    w = events.withWatermark("ts", late) if events.isStreaming else events
    g = w.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
