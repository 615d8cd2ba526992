"""Counts over time on a stream: an event-time window with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``start, kind, n`` of a stream or table; rows more than ``late`` behind are dropped by a stream."""
    w = stream.withColumn(time, F.col(time).cast("timestamp"))
    w = w.withWatermark(time, late) if stream.isStreaming else w
    return w.groupBy(F.window(time, width).alias("_w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), kind, "n")


def stream_parquet(spark: SparkSession, path: str, like: str) -> DataFrame:
    """New Parquet files of a folder as a stream, with the schema of ``like``."""
    return spark.readStream.schema(spark.read.parquet(like).schema).parquet(path)
