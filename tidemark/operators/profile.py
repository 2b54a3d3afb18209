"""Statistics of the variables of a series, per asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..roles import LEVELS
from . import ranks

PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


def _long(series: DataFrame, variables: tuple[str, ...]) -> DataFrame:
    """asset_id, variable, value: one row per cell, from one scan."""
    return series.unpivot("asset_id", list(variables), "variable", "value")


def stats(series: DataFrame, variables: tuple[str, ...] = LEVELS) -> DataFrame:
    """Range of time and, for each variable, min, max, mean, median, std, n_total, n_valid, missing_pct.

    The median is found by counts (``ranks``), so no task holds an asset's values.
    """
    def of(v: str) -> list[Column]:
        share = F.try_divide((F.count("*") - F.count(v)) * F.lit(100.0), F.count("*"))
        return [
            F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.avg(v).alias(f"{v}_mean"),
            F.stddev_samp(v).alias(f"{v}_std"), F.count("*").alias(f"{v}_n_total"), F.count(v).alias(f"{v}_n_valid"), share.alias(f"{v}_missing_pct"),
        ]
    per = series.groupBy("asset_id").agg(F.min("timestamp").alias("date_min"), F.max("timestamp").alias("date_max"), *(c for v in variables for c in of(v)))
    middle = ranks.quantiles(_long(series, variables), ["asset_id", "variable"], "value", [0.5])
    middle = middle.groupBy("asset_id").agg(*(F.max(F.when(F.col("variable") == v, F.col("value"))).alias(f"{v}_median") for v in variables))
    names = ("min", "max", "mean", "median", "std", "n_total", "n_valid", "missing_pct")
    both = per.join(middle.withColumnRenamed("asset_id", "_of"), F.col("asset_id").eqNullSafe(F.col("_of")), "left")
    return both.select("asset_id", "date_min", "date_max", *(f"{v}_{n}" for v in variables for n in names))


def percentiles(series: DataFrame, variables: tuple[str, ...] = LEVELS, points: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """Exact, linearly interpolated; a variable without values has NULLs."""
    rows = _long(series, variables)
    found = ranks.quantiles(rows, ["asset_id", "variable"], "value", [p / 100 for p in points])
    without = rows.groupBy("asset_id", "variable").agg(F.count("value").alias("n")).where("n = 0")
    without = without.select("asset_id", "variable", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))).alias("point"), F.lit(None).cast("double").alias("value"))
    name = F.element_at(F.array(*(F.lit(f"P{p}") for p in points)), F.col("point") + 1)
    return found.unionByName(without).select("asset_id", "variable", name.alias("percentile"), "value")


def histogram(rows: DataFrame, value: str, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Equal bins from least to largest value of each key: keys, bin_left, bin_right, count; empty bins included.

    Bins are closed on the left, the last on both sides; equal values get a
    range of one around them.  Infinite values are an error.
    """
    keys = keys or []
    x = F.col(value)
    rows = rows.select(*keys, x.alias("x")).where("x IS NOT NULL")
    checked = F.when(F.abs("x") == float("inf"), F.raise_error(F.lit("histogram of an infinite value"))).otherwise(F.col("x"))
    ends = rows.groupBy(*keys).agg(F.min(checked).alias("lo"), F.max(checked).alias("hi")).where("lo IS NOT NULL")
    same = F.col("lo") == F.col("hi")
    ends = ends.select(*keys, (F.col("lo") - F.when(same, 0.5).otherwise(0.0)).alias("lo"), (F.col("hi") + F.when(same, 0.5).otherwise(0.0)).alias("hi"))
    edge = lambda i: F.when(i == bins, F.col("hi")).otherwise(F.col("lo") + i * ((F.col("hi") - F.col("lo")) / F.lit(bins)))
    if keys:
        placed = rows.join(ends, keys)
    else:
        placed = rows.crossJoin(F.broadcast(ends))  # one row
    near = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"), F.lit(bins - 1))
    placed = placed.withColumn("i", near)
    # rounding may put a value one bin off; its edges decide
    i = F.col("i")
    right = F.when(F.col("x") < edge(i), i - 1).when((F.col("x") >= edge(i + 1)) & (i < bins - 1), i + 1).otherwise(i)
    counts = placed.withColumn("i", right).groupBy(*keys, "i").agg(F.count("*").alias("n"))
    every = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*keys, "i"], "left").select(*keys, edge(F.col("i")).alias("bin_left"), edge(F.col("i") + 1).alias("bin_right"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def correlation(series: DataFrame, x: str = LEVELS[0], y: str = LEVELS[1]) -> DataFrame:
    """Pearson's r and the least-squares line of y on x over rows that have both; assets with one such row are left out.

    With constant x all is NULL, with constant y r and r2 are.
    """
    pairs = series.na.drop(subset=[x, y]).groupBy("asset_id").agg(
        F.count("*").alias("n"), F.covar_pop(x, y).alias("xy"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        (F.min(x) == F.max(x)).alias("flat_x"), (F.min(y) == F.max(y)).alias("flat_y"),
    ).where("n >= 2")
    live = ~F.col("flat_x")
    slope = F.when(live, F.try_divide("xy", "xx"))
    r = F.when(live & ~F.col("flat_y"), F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")))
    return pairs.select("asset_id", r.alias("pearson_r"), slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), (r * r).alias("r2"))


def scatter(series: DataFrame, x: str = LEVELS[0], y: str = LEVELS[1]) -> DataFrame:
    """The pairs behind ``correlation``."""
    pairs = series.select("asset_id", x, y).na.drop(subset=[x, y])
    enough = pairs.groupBy("asset_id").agg(F.count("*").alias("n")).where("n >= 2").select("asset_id")
    return pairs.join(enough, "asset_id", "left_semi")


def missing_level_notes(series: DataFrame, variables: tuple[str, ...] = LEVELS) -> DataFrame:
    """variable, assets: assets without one value of a variable, joined by "; "."""
    none = _long(series, variables).groupBy("variable", "asset_id").agg(F.count("value").alias("n")).where("n = 0")
    return none.groupBy("variable").agg(F.array_join(F.array_sort(F.collect_list("asset_id")), "; ").alias("assets"))
