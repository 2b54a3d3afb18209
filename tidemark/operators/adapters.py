"""The events table as telemetry: event types are assets, with two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, timestamp, event_id, nivelPorcentual (every 17th NULL), nivelEstanque."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("asset_id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), "event_id",
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("nivelPorcentual"),
        F.regexp_extract("props", r"(\d+)", 1).try_cast("double").alias("nivelEstanque"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times cut to the hour, so that there are repeated ones."""
    return series(spark, sf_dir).withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly times five days later, so that two months and a month's last day occur."""
    return hourly(spark, sf_dir).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL '5' DAY"))
