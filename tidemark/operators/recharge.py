"""Recharge events: rises of a smoothed level from a minimum to a maximum.

Rows are ordered by time, ties by ``tiebreak``.  Minima are paired with maxima
greedily: each minimum, in order, takes the first unused maximum after it.  With
minimum k and F(k) = 1 + the maxima at or before it, the maximum taken is number
k + max over j <= k of (F(j) - j), so the pairing is a running maximum and an
equi-join instead of a loop.

Rows are ordered within days of an asset, and days among each other (``blocks``),
so one asset's rows are not one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MINUTE, micros
from ..roles import LEVELS
from ..session import once
from . import blocks

WINDOW, MIN_AMPLITUDE, MIN_MINUTES = 5, 10.0, 30.0


MIN, MAX = "coalesce({b} > {v} AND {v} <= {a}, false) AS is_min", "coalesce({b} < {v} AND {v} >= {a}, false) AS is_max"


def _levels(series: DataFrame, level: str, reach: int, tiebreak: tuple[str, ...], block: str) -> DataFrame:
    """Rows with a level as ``v``, their place ``i`` and the ``reach`` levels on either side; without a ``tiebreak`` rows of one time are ordered by level."""
    rows = series.where(F.col(level).isNotNull()).select("asset_id", "timestamp", *tiebreak, F.col(level).alias("v"))
    return blocks.neighbours(rows, "v", reach, ["timestamp", *(tiebreak or ["v"])], block, place="i")


def _medians(rows: DataFrame, windows: dict[str, list[str]]) -> DataFrame:
    """Adds the median of each list of columns, NULLs aside; one at least is not NULL."""
    # one row is made of each: filters on medians would else be moved below and work them out anew at each mention
    each = ", ".join(f"'{c}_s', sort_array(array({', '.join(cs)}), false), '{c}_n', {' + '.join(f'int({x} IS NOT NULL)' for x in cs)}" for c, cs in windows.items())
    rows = rows.select("*", F.expr(f"inline(array(named_struct({each})))"))
    # the NULLs come last
    return rows.withColumns({c: F.expr(f"({c}_s[({c}_n - 1) div 2] + {c}_s[{c}_n div 2]) / 2") for c in windows})


def _around(reach: int) -> list[str]:
    """Columns of a row's level and of those on either side, in order."""
    return [*(f"_b{k}" for k in range(reach, 0, -1)), "v", *(f"_a{k}" for k in range(1, reach + 1))]


def smoothed(series: DataFrame, level: str = LEVELS[0], width: int = WINDOW, tiebreak: tuple[str, ...] = (), block: str = blocks.BLOCK) -> DataFrame:
    """asset_id, timestamp, tiebreak, i (place in time) and v: the median of the ``width`` rows around; rows with a level only."""
    rows = _medians(_levels(series, level, width // 2, tiebreak, block), {"_v": _around(width // 2)})
    return rows.select("asset_id", "timestamp", *tiebreak, "i", F.col("_v").alias("v"))


def extrema(smooth: DataFrame, rows_a_block: int = 10_000) -> DataFrame:
    """Adds is_min and is_max to asset_id, i and v; a plateau's first row alone is compared strictly with the row before."""
    rows = blocks.neighbours(smooth, "v", 1, ["i"], F.floor(F.col("i") / rows_a_block))
    return rows.select(*smooth.columns, *(F.expr(e.format(b="_b1", v="v", a="_a1")) for e in (MIN, MAX)))


def turning_points(series: DataFrame, level: str = LEVELS[0], width: int = WINDOW, tiebreak: tuple[str, ...] = (), block: str = blocks.BLOCK) -> DataFrame:
    """``extrema`` of ``smoothed`` in one pass: the medians of a row and of its two neighbours from the levels around; extrema only."""
    half = width // 2
    x = _around(half + 1)
    rows = _medians(_levels(series, level, half + 1, tiebreak, block).where("_b1 IS NOT NULL AND _a1 IS NOT NULL"), {c: x[k : k + 2 * half + 1] for k, c in enumerate(("_before", "_v", "_after"))})
    marks = (F.expr(e.format(b="_before", v="_v", a="_after")) for e in (MIN, MAX))
    return rows.select("asset_id", "timestamp", *tiebreak, "i", F.col("_v").alias("v"), *marks).where("is_min OR is_max")


def recharge_events(series: DataFrame, level: str = LEVELS[0], width: int = WINDOW, min_amplitude: float = MIN_AMPLITUDE, min_minutes: float = MIN_MINUTES, tiebreak: tuple[str, ...] = (), block: str = blocks.BLOCK) -> DataFrame:
    marked = blocks.with_block(turning_points(series, level, width, tiebreak, block), block)
    up_to = blocks.inside(["timestamp", "i"]).rowsBetween(Window.unboundedPreceding, 0)
    # within a block: minima k and maxima c so far, and the running maximum of c - k over minima
    marked = marked.withColumns({"k": F.count(F.when(F.col("is_min"), 1)).over(up_to), "c": F.count(F.when(F.col("is_max"), 1)).over(up_to)})
    marked = marked.withColumn("most", F.max(F.when(F.col("is_min"), F.col("c") - F.col("k"))).over(up_to))
    marked = once(marked)
    # and in all blocks before
    days = marked.groupBy("asset_id", "_block").agg(F.max("k").alias("_k"), F.max("c").alias("_c"), F.max("most").alias("_most"))
    days = blocks.earlier(days, {"_k0": F.sum("_k"), "_c0": F.sum("_c")}).na.fill(0, ["_k0", "_c0"]).withColumn("_most", F.expr("_most + _c0 - _k0"))
    days = blocks.earlier(days, {"_most0": F.max("_most")}).select("asset_id", "_block", "_k0", "_c0", "_most0")
    marked = blocks.joined(marked, days)
    number = F.expr("CASE WHEN is_min THEN _k0 + k + 1 + greatest(_most0, most + _c0 - _k0) ELSE _c0 + c END")
    # a number has one minimum and one maximum at most
    of = lambda kind, c: F.max(F.when(F.col(kind), F.col(c)))
    pairs = marked.groupBy("asset_id", number.alias("number")).agg(
        of("is_min", "timestamp").alias("start_time"), of("is_max", "timestamp").alias("end_time"), of("is_min", "v").alias("level_start"), of("is_max", "v").alias("level_end"),
    ).where("start_time IS NOT NULL AND end_time IS NOT NULL")
    minutes = (micros(F.col("end_time")) - micros(F.col("start_time"))) / MINUTE
    pairs = pairs.select("asset_id", "start_time", "end_time", minutes.alias("duration_minutes"), "level_start", "level_end", (F.col("level_end") - F.col("level_start")).alias("amplitude"))
    return pairs.where((F.col("amplitude") >= min_amplitude) & (F.col("duration_minutes") >= min_minutes))
