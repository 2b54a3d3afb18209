"""Reports: named bundles of result tables.  Counts by key, no charts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import once
from . import integrity, profile, recharge

VERSION = "1"


def strategy(files: DataFrame) -> DataFrame:
    """strategy: ``unknown`` without files, the only one, or ``mixed``; strategies: sorted and distinct."""
    found = files.agg(F.array_sort(F.collect_set("strategy")).alias("strategies"))
    n = F.size("strategies")
    return found.select(F.when(n == 0, "unknown").when(n == 1, F.try_element_at("strategies", F.lit(1))).otherwise("mixed").alias("strategy"), "strategies")


def notes(spark, given: dict[str, object]) -> DataFrame:
    """key, value rows of the run's parameters."""
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in (given | {"version": VERSION}).items()], "key string, value string")


def _run(start, end, asset, files: DataFrame | None, run: dict[str, object] | None) -> dict[str, object]:
    """What every report notes: the run (group, input, output, time), its bounds, the kinds of times found."""
    found = strategy(files).first() if files is not None else None
    return {"run_at": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S"), **(run or {}), "start": start, "end": end, "asset": asset,
            "timestamp_strategy": found["strategy"] if found else "unknown", "timestamp_strategies": ", ".join(found["strategies"]) if found else ""}


def without_rows(series: DataFrame, rows: DataFrame, asset: str | None = None) -> DataFrame:
    """asset: those of the series, and of the pattern, that have no rows in the report's range."""
    every = integrity.bounded(series, asset=asset).select(F.col("asset_id").alias("asset")).distinct()
    return every.join(rows.select(F.col("asset_id").alias("asset")).distinct(), "asset", "left_anti")


#: A table with a column for each asset is made for so many assets at most; the table of months has the same figures.
PIVOT_ASSETS = 1000


def integrity_report(series: DataFrame, freq: int = 1, start: datetime | None = None, end: datetime | None = None, asset: str | None = None, files: DataFrame | None = None, run: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """Tables by name; the series is read once for all of them where a checkpoint folder is set."""
    series = once(series)
    rows = integrity.bounded(series, start, end, asset)
    months = once(integrity.monthly(rows, freq, start, end))
    tables = {
        "Summary": integrity.summary(rows, freq, start, end),
        "Gaps": integrity.gaps(rows, freq),
        "Duplicates": integrity.duplicates(rows),
        "DuplicateExamples": integrity.duplicate_examples(rows),
        "Monthly": months,
        "NoRows": without_rows(series, rows, asset),
    }
    given = {"freq_minutes": max(1, freq)} | _run(start, end, asset, files, run)
    names = [r["asset"] for r in months.select("asset").distinct().orderBy("asset").limit(PIVOT_ASSETS + 1).collect()]
    if len(names) > PIVOT_ASSETS:
        given["monthly_pivot"] = f"left out: more than {PIVOT_ASSETS} assets"
    elif months.select("month").distinct().limit(2).count() > 1:
        tables["MonthlyPivot"] = integrity.monthly_pivot(months, names)
    return tables | {"Notes": notes(series.sparkSession, given)}


def tank_report(series: DataFrame, bins: int = 20, start: datetime | None = None, end: datetime | None = None, asset: str | None = None, tiebreak: tuple[str, ...] = (), files: DataFrame | None = None, run: dict[str, object] | None = None) -> dict[str, DataFrame]:
    """Tables by name; the series is read once for all of them where a checkpoint folder is set."""
    series = once(series)
    rows = integrity.bounded(series, start, end, asset)
    events = once(recharge.recharge_events(rows, tiebreak=tiebreak))
    return {
        "Summary": profile.stats(rows),
        "Percentiles": profile.percentiles(rows),
        "Hist_nivelPorcentual": profile.histogram(rows, "nivelPorcentual", bins, ["asset_id"]),
        "RechargeEvents": events,
        "AmplitudeHistogram": profile.histogram(events, "amplitude", 10),
        "Correlation": profile.correlation(rows),
        "Scatter": profile.scatter(rows),
        "NoRows": without_rows(series, rows, asset),
        "Notes": notes(series.sparkSession, {"bins": bins} | _run(start, end, asset, files, run)).unionByName(
            profile.missing_level_notes(rows).select(F.concat(F.lit("no data: "), "variable").alias("key"), F.col("assets").alias("value"))),
    }
