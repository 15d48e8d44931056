"""Continuous log ingest (extension X): the same parse over a folder that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrylog.functions.text import from_epoch_ms
from quarrylog.sources.logs import parse_lines


def stream_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.readStream.option("lineSep", "\n").text(path))


def windowed_counts(logs: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events per tumbling window, resource and type; state is dropped once the watermark passes."""
    timed = logs.where(~F.col("ts_bad")).withColumn("ts", from_epoch_ms(F.col("epoch_ms")).cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "resource_id", "event_type").agg(F.count("*").alias("n"))
