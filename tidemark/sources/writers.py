"""Sinks: wide and long exports, report bundles, catalogs and samples."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sanitize

LAYOUT = ("group", "asset", "year", "month")
#: A folder that readers of the layout pass over.
FETCHED = "_fetched"


def write_wide(wide: DataFrame, path: str, group: str) -> None:
    """One folder for each group, asset, year and month, rows by ts; a month that is there is replaced, others stay."""
    rows = wide.select(F.lit(group).alias("group"), sanitize(F.col("asset_label")).alias("asset"), "*")
    rows = rows.repartition("asset", "year", "month").sortWithinPartitions("asset", "year", "month", "ts")
    columns = [c for c in rows.columns if c not in LAYOUT]
    rows = rows.select(*columns, *LAYOUT)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*LAYOUT).csv(path, header=True)


def mark_fetched(work: DataFrame, path: str, group: str) -> None:
    """Add the asset-months of a work-list to the list of what is done, once their rows are there; also those that had none and so left no folder.

    A list is written whole or not at all, by Spark's committer.
    """
    done = work.select(F.lit(group).alias("group"), sanitize(F.col("asset_label")).alias("asset"), "year", "month")
    done.coalesce(1).write.mode("append").json(f"{path}/{FETCHED}")


DONE = "`group` string, asset string, year int, month int"


def written(spark, path: str) -> DataFrame | None:
    """group, asset, year, month of what is there: from the lists of what is done, and for exports without one from the names of folders; None without either.

    Exported rows are not read.
    """
    found = None
    for rows in (lambda: spark.read.schema(DONE).json(f"{path}/{FETCHED}"), lambda: _folders(spark, path)):
        try:
            part = rows()
        except AnalysisException:
            continue
        found = part if found is None else found.union(part)
    return found and found.distinct()


def _folders(spark, path: str) -> DataFrame:
    """The layout's folders that hold files; files are listed and not opened."""
    schema = f"path string, modificationTime timestamp, length long, content binary, {DONE}"
    return spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "*.csv").load(path).select("group", "asset", "year", "month").where("month IS NOT NULL").distinct()


def write_long(points: DataFrame, path: str) -> None:
    """timestamp_ms, key, value, datetime by time."""
    points.select("timestamp_ms", "key", "value", "datetime").sortWithinPartitions("timestamp_ms").write.mode("overwrite").csv(path, header=True)


def write_report(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """A folder for each table."""
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        writer.csv(f"{path}/{name}", header=True) if form == "csv" else writer.parquet(f"{path}/{name}")


def write_samples(rows: DataFrame, path: str, asset: str | None = None) -> None:
    """CSV, a folder for each asset."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(asset) if asset else writer).csv(path, header=True)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.coalesce(1).write.mode("overwrite").json(path)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Quotes inside are doubled."""
    catalog.coalesce(1).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def run_stamp(spark, url: str) -> DataFrame:
    """One row: when, and from where."""
    return spark.range(1).select(F.current_timestamp().alias("timestamp"), F.lit(url).alias("ws_url"))
