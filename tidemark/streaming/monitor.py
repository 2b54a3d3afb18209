"""Completeness of a live series in tumbling windows; late rows up to the watermark are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def completeness(series: DataFrame, value: str, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """asset_id, window_start, obs, mean; works on streams and on tables."""
    rows = series.select("asset_id", F.col("timestamp").cast("timestamp").alias("timestamp"), value)
    if series.isStreaming:
        rows = rows.withWatermark("timestamp", lateness)
    per = rows.groupBy("asset_id", F.window("timestamp", window)).agg(F.count("*").alias("obs"), F.avg(value).alias("mean"))
    return per.select("asset_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"), "obs", "mean")


def batch_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("asset_id"), F.col("ts").alias("timestamp"), "value")
    return completeness(rows, "value").withColumn("mean", F.round("mean", 6))


def stream_to(series: DataFrame, value: str, path: str, checkpoint: str, **settings):
    """Start writing closed windows as Parquet; ends when what is there is processed."""
    out = completeness(series, value, **settings)
    return out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
