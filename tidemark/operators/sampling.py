"""Anonymised samples of a table with an asset and a timestamp column."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import once

NUMERIC = (T.FloatType, T.DoubleType, T.DecimalType)


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Adds 1, 2, ... in an order without ties.

    Rows are sorted in parts by range; what is counted on the driver are the parts.  The parts are written, or kept on the
    executors' disks where no checkpoint folder is set, as ranges that are made anew may be others.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    kept = once(parts)
    kept = kept.persist(StorageLevel.DISK_ONLY) if kept is parts else kept
    counts = kept.groupBy("_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).orderBy("_part").collect()  # a row for each part
    before, at = [], 0
    for part, first, n in counts:
        before.append((part, at - first + 1))
        at += n
    shift = rows.sparkSession.createDataFrame(before, "_part int, _shift long")
    return kept.join(F.broadcast(shift), "_part").select(*rows.columns, (F.col("_id") + F.col("_shift")).alias(name))


def by_appearance(rows: DataFrame, asset: str, order: list[str]) -> DataFrame:
    """asset, first: the first row's ``order`` of each asset."""
    return rows.where(F.col(asset).isNotNull()).groupBy(asset).agg(F.min(F.struct(*order)).alias("first"))


def aliases(rows: DataFrame, asset: str, order: list[str]) -> DataFrame:
    """asset, alias (ASSET_001 for the first to appear, ...)."""
    numbers = numbered(by_appearance(rows, asset, order), ["first", asset])
    return numbers.select(asset, F.format_string("ASSET_%03d", "number").alias("alias"))


def anonymised(rows: DataFrame, asset: str, order: list[str], drop_identifiers: bool = False) -> DataFrame:
    """``asset`` replaced by its alias; on request the columns that name it otherwise go too."""
    out = rows.join(aliases(rows, asset, order), asset, "left").withColumn(asset, F.col("alias")).drop("alias")
    return out.drop("asset_id", "asset_name") if drop_identifiers else out


def first_assets(rows: DataFrame, asset: str, n: int, order: list[str]) -> DataFrame:
    """Rows of the first ``n`` assets to appear."""
    few = by_appearance(rows, asset, order).orderBy("first", asset).limit(n).select(asset)
    return rows.join(few, asset, "left_semi")


def only_assets(rows: DataFrame, asset: str, names: list[str]) -> DataFrame:
    return rows.where(F.col(asset).isin(*names))


def head(rows: DataFrame, n: int | None, order: list[str], asset: str | None = None) -> DataFrame:
    """The first ``n`` rows of each asset, or of all; 0 and None keep everything."""
    if not n:
        return rows
    if asset is None:
        return rows.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(asset).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def rounded(rows: DataFrame, digits: int) -> DataFrame:
    """Fractional columns rounded half to even."""
    return rows.select(*(F.bround(f.name, digits).alias(f.name) if isinstance(f.dataType, NUMERIC) else F.col(f.name) for f in rows.schema))


def manifest(rows: DataFrame, timestamp: str, asset: str | None = None, parameters: dict[str, str] | None = None) -> DataFrame:
    """One row: assets_included, date_range, columns, rows_per_asset, parameters."""
    name = F.col(asset) if asset else F.lit("ALL")
    per = rows.groupBy(name.alias("asset")).agg(F.count("*").alias("n"), F.min(timestamp).alias("lo"), F.max(timestamp).alias("hi"))
    given = parameters or {}
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return per.agg(
        F.array_sort(F.collect_set("asset")).alias("assets_included"), F.struct(iso(F.min("lo")).alias("min"), iso(F.max("hi")).alias("max")).alias("date_range"),
        F.array(*map(F.lit, rows.columns)).alias("columns"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("asset").isNotNull(), F.struct("asset", "n"))))).alias("rows_per_asset"),
        (F.create_map(*(F.lit(x) for kv in given.items() for x in kv)) if given else F.create_map().cast("map<string,string>")).alias("parameters"),
    )
