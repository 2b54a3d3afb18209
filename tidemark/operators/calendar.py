"""Month ranges in a time zone and the work-list of an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _months(spark: SparkSession, first, last) -> DataFrame:
    every = F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("INTERVAL '1' MONTH")))
    return spark.range(1).select(every.alias("month"))


def month_ranges(spark: SparkSession, first: str, last: str, zone: str) -> DataFrame:
    """year, month, start and end (00:00:00 of the first and 23:59:59 of the last day, local), start_ms, end_ms; ``YYYY-MM`` inclusive."""
    day = lambda ym: F.to_date(F.lit(ym + "-01"))
    rows = _months(spark, day(first), day(last)).select(
        F.year("month").alias("year"), F.month("month").alias("month"), F.col("month").cast("timestamp_ntz").alias("start"),
        (F.last_day("month").cast("timestamp_ntz") + F.expr("INTERVAL '86399' SECOND")).alias("end"),
    )
    ms = lambda c: F.unix_millis(F.to_utc_timestamp(F.col(c).cast("timestamp"), zone))
    return rows.select("*", ms("start").alias("start_ms"), ms("end").alias("end_ms"))


def month_spans(spark: SparkSession, start: str, end: str) -> DataFrame:
    """start, end of each month from that of ``start`` on, to the millisecond; the last one ends at ``end``."""
    first, last = (F.to_timestamp(F.lit(d), "yyyy-MM-dd").cast("timestamp_ntz") for d in (start, end))
    rows = _months(spark, first.cast("date"), last.cast("date")).select(F.col("month").cast("timestamp_ntz").alias("start"), last.alias("last"))
    close = F.add_months(F.col("start").cast("date"), 1).cast("timestamp_ntz") - F.expr("INTERVAL '0.001' SECOND")
    return rows.where(F.col("start") <= F.col("last")).select("start", F.least(close, F.col("last")).alias("end"))


def work_list(assets: DataFrame, months: DataFrame) -> DataFrame:
    """Every asset with every month; months are a few rows, made from two dates."""
    return assets.crossJoin(F.broadcast(months))


def still_to_do(work: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Rows of a work-list that have no output yet."""
    return work if overwrite else work.join(done.select(*keys).distinct(), keys, "left_anti")
