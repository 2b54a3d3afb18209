"""Temporal integrity of a series (asset_id, timestamp) against a cadence.

``freq`` is the cadence in minutes, 1 at least; ``start`` and ``end`` bound the
range, else each asset's own data do.  Bounds are inclusive.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MINUTE, matches, micros


def bounded(series: DataFrame, start: datetime | None = None, end: datetime | None = None, asset: str | None = None) -> DataFrame:
    """Rows in range, of assets whose id the pattern is found in; rows without asset or time are dropped."""
    rows = series.na.drop(subset=["asset_id", "timestamp"])
    for limit, keep in ((start, F.col("timestamp").__ge__), (end, F.col("timestamp").__le__)):
        if limit is not None:
            rows = rows.where(keep(F.lit(limit).cast("timestamp_ntz")))
    return rows if asset is None else rows.where(matches(F.col("asset_id"), asset))


def expected_count(start: Column, end: Column, freq: int) -> Column:
    """Slots of the cadence in [start, end]; 0 if that is empty or a bound is missing."""
    span = micros(end) - micros(start)
    return F.when(span >= 0, F.floor(span / F.lit(freq * MINUTE)) + 1).otherwise(0).cast("long")


def missing_pct(obs: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.greatest(expected - obs, F.lit(0)) / expected * 100).otherwise(F.lit(0.0))


def _limit(bound: datetime | None, own: Column) -> Column:
    return own if bound is None else F.lit(bound).cast("timestamp_ntz")


def all_gaps(series: DataFrame, freq: int) -> DataFrame:
    """asset_id, gap_start, gap_end, gap (microseconds) of neighbours further apart than the cadence.

    Neighbours are looked for within a day of an asset, and between days by
    their first and last rows, so one asset's rows are not one task's work.
    """
    freq = max(1, freq)
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    rows = series.select("asset_id", "timestamp", day.alias("day"))
    inside = Window.partitionBy("asset_id", "day").orderBy("timestamp")
    within = rows.select("asset_id", F.lag("timestamp").over(inside).alias("gap_start"), F.col("timestamp").alias("gap_end"))
    days = rows.groupBy("asset_id", "day").agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    between = days.select("asset_id", F.lag("last").over(Window.partitionBy("asset_id").orderBy("day")).alias("gap_start"), F.col("first").alias("gap_end"))
    pairs = within.unionByName(between).withColumn("gap", micros(F.col("gap_end")) - micros(F.col("gap_start")))
    return pairs.where(F.col("gap") > freq * MINUTE)


def gaps(series: DataFrame, freq: int = 1, top: int = 10) -> DataFrame:
    """The longest gaps of each asset, ties by time."""
    freq = max(1, freq)
    longest = Window.partitionBy("asset_id").orderBy(F.desc("gap"), "gap_start")
    found = all_gaps(series, freq).withColumn("place", F.row_number().over(longest)).where(F.col("place") <= top)
    lost = F.greatest(F.floor(F.col("gap") / F.lit(freq * MINUTE)) - 1, F.lit(0)).cast("long")
    return found.select(F.col("asset_id").alias("asset"), "gap_start", "gap_end", (F.col("gap") / MINUTE).alias("gap_minutes"), lost.alias("missing_points_est"))


def duplicates(series: DataFrame) -> DataFrame:
    """Times that an asset has more than once."""
    return series.groupBy(F.col("asset_id").alias("asset"), "timestamp").agg(F.count("*").alias("count")).where("count > 1")


def duplicate_examples(series: DataFrame, n: int = 5) -> DataFrame:
    """The first few repeated times of each asset as text."""
    by_time = Window.partitionBy("asset").orderBy("timestamp")
    few = duplicates(series).withColumn("place", F.row_number().over(by_time)).where(F.col("place") <= n)
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return few.groupBy("asset").agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("examples"))


def summary(series: DataFrame, freq: int = 1, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """One row per asset.  Repeated times count as observations and so can hide missing ones."""
    freq = max(1, freq)
    times = series.groupBy("asset_id", "timestamp").agg(F.count("*").alias("n"))
    per = times.groupBy("asset_id").agg(
        F.sum("n").alias("obs"), F.sum(F.col("n") - 1).alias("dup_count"), F.min("timestamp").alias("date_min"), F.max("timestamp").alias("date_max")
    )
    longest = all_gaps(times, freq).groupBy("asset_id").agg((F.max("gap") / MINUTE).alias("max_gap"))
    per = per.join(longest, "asset_id", "left")
    expected = expected_count(_limit(start, F.col("date_min")), _limit(end, F.col("date_max")), freq)
    return per.select(
        F.col("asset_id").alias("asset"), "obs", expected.alias("expected"), missing_pct(F.col("obs"), expected).alias("missing_pct"), "dup_count",
        F.coalesce("max_gap", F.lit(0.0)).alias("max_gap_minutes"), "date_min", "date_max",
    )


def monthly(series: DataFrame, freq: int = 1, start: datetime | None = None, end: datetime | None = None, month_end: str = "midnight") -> DataFrame:
    """Completeness by month.  With ``midnight`` a month ends at 00:00 of its last day, with ``full`` at its last slot."""
    freq = max(1, freq)
    first = F.date_trunc("month", "timestamp").cast("timestamp_ntz")
    last = F.last_day("timestamp").cast("timestamp_ntz")
    if month_end == "full":
        last = last + F.expr(f"INTERVAL '1' DAY - INTERVAL '{freq}' MINUTE")
    rows = series.select("asset_id", "timestamp", first.alias("first"), last.alias("last"))
    per = rows.groupBy("asset_id", "first", "last").agg(
        F.count(F.when(F.col("timestamp") <= F.col("last"), 1)).alias("obs"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    months = Window.partitionBy("asset_id")
    own = lambda bound, f, c: _limit(bound, f(c).over(months))
    per = per.withColumns({"from": F.greatest("first", own(start, F.min, "lo")), "to": F.least("last", own(end, F.max, "hi"))}).where(F.col("from") <= F.col("to"))
    expected = expected_count(F.col("from"), F.col("to"), freq)
    return per.select(
        F.col("asset_id").alias("asset"), F.date_format("first", "yyyy-MM").alias("month"), "obs", expected.alias("expected"),
        missing_pct(F.col("obs"), expected).alias("missing_pct"),
    )


def monthly_pivot(months: DataFrame, assets: list[str]) -> DataFrame:
    """A column of missing_pct for each asset, 0 where a month has none."""
    return months.groupBy("month").pivot("asset", assets).agg(F.first("missing_pct")).na.fill(0.0, subset=assets)
