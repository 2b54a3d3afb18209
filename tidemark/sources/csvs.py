"""CSV exports of telemetry with headers that differ from file to file.

Spark matches CSV columns by position, so files are grouped by header and each
group is read by itself, all columns as text; the groups are united by name.
Headers are read by Spark tasks, from the first bytes of each file (``headers``).  Files that give nothing are listed with
the reason.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..roles import ASSET_LABEL, LEVELS, SAMPLE_ASSET_NAMES, TIMESTAMP_NAMES, find_column, level_columns
from .headers import first_lines

FILE = "_file"
CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Scan:
    """``rows``: asset_id, timestamp, levels and file; ``files``: file, strategy, n_rows, n_invalid, columns; ``skipped``: file, reason."""

    rows: DataFrame
    files: DataFrame
    skipped: DataFrame


def decoded_path(path: Column) -> Column:
    """The metadata column's path is URL-encoded, where "+" is a plus."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _names(header: str) -> tuple[str, ...]:
    return tuple(c.strip().strip('"') for c in header.split(","))


def headers(spark: SparkSession, folder: str) -> dict[tuple[str, ...], list[str]]:
    """Files by header, below ``folder``; files without a line have none and are left out.

    The driver holds the paths, as Spark's own listing of the files that it is to read does.
    """
    out: dict[tuple[str, ...], list[str]] = {}
    for r in first_lines(spark, folder).where("header <> ''").orderBy("path").toLocalIterator():
        out.setdefault(_names(r["header"]), []).append(r["path"])
    return out


def _group(spark: SparkSession, names: tuple[str, ...], paths: list[str], drop_corrupt_files: bool) -> DataFrame:
    """The files of one header: cells as text in columns c0, c1, ... (a header may repeat a name), and the decoded path."""
    cells = [f"c{i}" for i in range(len(names))]
    schema = ", ".join(f"`{n}` string" for n in [*cells, CORRUPT])
    rows = spark.read.schema(schema).csv(paths, header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    rows = rows.select("*", decoded_path(F.col("_metadata.file_path")).alias(FILE))
    if drop_corrupt_files:
        bad = rows.groupBy(FILE).agg(F.count(CORRUPT).alias("bad")).where("bad > 0").select(FILE)
        rows = rows.join(bad, FILE, "left_anti")
    return rows.select(*(scalars.not_available(F.col(c)).alias(c) for c in cells), FILE)


def _median_reaches(x: Column, bound: float) -> Column:
    """Whether the median of a group is at least ``bound``, from counts and the two values next to the bound."""
    n, above = F.count(x), F.count(F.when(x >= bound, 1))
    middle = (F.max(F.when(x < bound, x)) + F.min(F.when(x >= bound, x))) / 2
    return F.when(2 * above == n, middle >= bound).otherwise(2 * above > n)


def parsed_times(rows: DataFrame, column: str, per: str = FILE) -> DataFrame:
    """Adds timestamp and strategy.  The unit of numbers is that of their file's median, which is found without sorting them."""
    number = scalars.to_number(F.col(column))
    units = rows.groupBy(per).agg(F.count(number).alias("_n"), *(_median_reaches(number, at).alias(f"_{name}") for name, at in scalars.EPOCH_UNITS))
    rows = rows.join(units.withColumnRenamed(per, "_per"), F.col(per).eqNullSafe(F.col("_per"))).drop("_per")
    strategy = F.when(F.col("_n") == 0, "string")
    for name, _ in scalars.EPOCH_UNITS:
        strategy = strategy.when(F.col(f"_{name}"), name)
    strategy = strategy.otherwise("epoch_ns")
    at = F.when(strategy == "string", scalars.parse_text_timestamp(F.col(column))).otherwise(scalars.from_epoch(number, strategy))
    return rows.withColumns({"timestamp": at, "strategy": strategy}).drop("_n", *(f"_{name}" for name, _ in scalars.EPOCH_UNITS))


def asset_ids(rows: DataFrame, label: str | None) -> Column:
    """The trimmed label, else the file's folder, else the start of the file's name."""
    parts = F.split(F.col(FILE), "/")
    folder = F.try_element_at(parts, F.lit(-2))
    stem = F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"^([^_.]*)", 1)
    fallback = F.coalesce(F.nullif(folder, F.lit("")), stem)
    return F.coalesce(F.nullif(F.trim(F.col(f"`{label}`")), F.lit("")), fallback) if label else fallback


def read_series(spark: SparkSession, folder: str, levels: bool = True, drop_corrupt_files: bool = False) -> Scan:
    """The series of all CSV files below ``folder``; rows without a readable time are counted and dropped, files without one listed."""
    found = headers(spark, folder)
    every = [*LEVELS] if levels else []
    rows = None
    for names in sorted(found):
        time = find_column(list(names), TIMESTAMP_NAMES)
        if time is None:
            continue
        group = _group(spark, names, found[names], drop_corrupt_files)
        cell = lambda name: F.col(f"c{names.index(name)}")  # noqa: B023, E731
        held = level_columns(list(names)) if levels else {}
        values = [(scalars.to_number(cell(held[v])) if v in held else F.lit(None).cast("double")).alias(v) for v in every]
        label = find_column(list(names), (ASSET_LABEL,))
        part = group.select(asset_ids(group, f"c{names.index(label)}" if label else None).alias("asset_id"), cell(time).alias("_time"), *values, FILE, F.array(*(F.lit(c) for c in held.values())).cast("array<string>").alias("columns"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        empty = ", ".join(["asset_id string", "timestamp timestamp_ntz", *(f"{v} double" for v in every), f"{FILE} string"])
        files = spark.createDataFrame([], "file string, strategy string, n_rows long, n_invalid long, columns array<string>")
        rows = spark.createDataFrame([], empty)
    else:
        rows = parsed_times(rows, "_time")
        files = rows.groupBy(F.col(FILE).alias("file")).agg(
            F.first("strategy").alias("strategy"), F.count("*").alias("n_rows"), F.count(F.when(F.col("timestamp").isNull(), 1)).alias("n_invalid"), F.first("columns").alias("columns"))
    good = files.where("n_invalid < n_rows")
    return Scan(rows.where("timestamp IS NOT NULL").select("asset_id", "timestamp", *every, FILE), good, _skipped(spark, folder, found, files))


def _skipped(spark: SparkSession, folder: str, found: dict[tuple[str, ...], list[str]], files: DataFrame) -> DataFrame:
    """file, reason of every file that gave no rows; headers are few, files may be many."""
    plain = lambda c: F.regexp_replace(c, "^(file:)?/+", "file:/")
    listed = first_lines(spark, folder).select(plain("path").alias("file"), F.nullif("header", F.lit("")).alias("header"))
    with_time = [names for names in found if find_column(list(names), TIMESTAMP_NAMES)]
    names = F.transform(F.split("header", ","), lambda c: F.regexp_replace(F.trim(c), '^"+|"+$', ""))
    timed = reduce(lambda a, b: a | b, (names == F.array(*map(F.lit, n)) for n in with_time), F.lit(False))
    rows = listed.withColumn("timed", F.when(F.col("header").isNotNull(), timed)).join(files.select(plain("file").alias("file"), "n_rows", "n_invalid"), "file", "left")
    reason = (
        F.when(F.col("header").isNull(), "empty").when(~F.col("timed"), "no time column").when(F.col("n_rows") > F.col("n_invalid"), None)
        .when(F.col("n_rows") > 0, "no readable time").otherwise("no rows, or corrupt ones")
    )
    return rows.select("file", reason.alias("reason")).where("reason IS NOT NULL")


def read_sample_input(spark: SparkSession, path: str) -> tuple[DataFrame, str, str | None]:
    """One CSV file with ``timestamp`` parsed; its time and asset columns.  No readable time is an error."""
    rows = spark.read.csv(path, header=True).select("*", F.lit(path).alias(FILE))
    time = find_column(rows.columns, TIMESTAMP_NAMES)
    if time is None:
        raise ValueError("no timestamp column")
    rows = parsed_times(rows.withColumn(FILE, F.col(FILE)), time).drop("strategy", FILE)
    if rows.where("timestamp IS NOT NULL").isEmpty():
        raise ValueError("no readable timestamp")
    return rows, time, find_column(rows.columns, SAMPLE_ASSET_NAMES)
