"""Ordered operators over series that are cut into blocks of time.

A window over all rows of an asset is one task's work.  Here rows are ordered
within a block (a day by default) of an asset; what an order over all its rows
needs besides is told by a table of blocks, a few numbers each: how many rows
there are before a block, and the nearest values beyond its two ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "day"
ASSET = "asset_id"


def with_block(rows: DataFrame, block: str | Column = BLOCK, name: str = "_block") -> DataFrame:
    """``block`` is a unit of time or a column that does not decrease in the order."""
    return rows.withColumn(name, F.date_trunc(block, "timestamp").cast("timestamp_ntz") if isinstance(block, str) else block)


def inside(order: list[str], name: str = "_block"):
    """The window of a block in its order."""
    return Window.partitionBy(ASSET, name).orderBy(*order)


def neighbours(rows: DataFrame, value: str, reach: int, order: list[str], block: str | Column = BLOCK, place: str | None = None) -> DataFrame:
    """Adds ``_b1``, ``_b2`` ... and ``_a1``, ``_a2`` ...: the values before and after a row in the order of its asset, the nearest first, NULL where there is none.

    ``place``, if given, is added as the row's number in its asset's order, from 1.  ``value`` has no NULLs, and
    ``order`` has no ties and starts with the timestamp if ``block`` is a unit of time.
    """
    own, steps = inside(order), range(1, reach + 1)
    # a row's number in its block, and the block's rows by counting from the other end
    rows = with_block(rows, block).withColumns({"_at": F.row_number().over(own), "_left": F.row_number().over(Window.partitionBy(ASSET, "_block").orderBy(*map(F.desc, order)))})
    # a block's first and last rows are all that other blocks can need of it
    kept = max(1, reach)
    ends = rows.where((F.col("_at") <= kept) | (F.col("_left") <= kept)).select(ASSET, "_block", *order, value, "_at", "_left")
    far = Window.partitionBy(ASSET).orderBy(*order)
    seen = {f"_far_{side}{k}": move(value, k).over(far) for k in steps for side, move in (("b", F.lag), ("a", F.lead))}
    # rows of all blocks up to this one: each counts at its first row
    ends = ends.withColumns(seen | {"_until": F.sum(F.expr("CASE WHEN _at = 1 THEN _left END")).over(far)})
    blocks = ends.groupBy(ASSET, "_block").agg(
        F.expr("max(CASE WHEN _at = 1 THEN _until - _left END) AS _offset"),
        *(F.expr(f"max(CASE WHEN {'_at' if c.startswith('_far_b') else '_left'} = 1 THEN {c} END) AS {c}") for c in seen),
    )
    rows = rows.withColumns({f"_own_{side}{k}": move(value, k).over(own) for k in steps for side, move in (("b", F.lag), ("a", F.lead))})
    # what the block itself does not have is beyond it, the nearest first
    near = {f"_{side}{k}": F.expr("CASE " + " ".join(f"WHEN {have} = {h + 1} THEN _far_{side}{k - h}" for h in range(k)) + f" ELSE _own_{side}{k} END") for k in steps for side, have in (("b", "_at"), ("a", "_left"))}
    out = joined(rows, blocks).withColumns(near | ({place: F.expr("int(_offset + _at)")} if place else {}))
    return out.drop("_block", "_at", "_left", "_offset", *seen, *(c.replace("_far", "_own") for c in seen))


def earlier(blocks: DataFrame, found: dict[str, Column]) -> DataFrame:
    """``found``, aggregates over blocks, for all blocks of the asset before each one; ``blocks`` has a row for each block."""
    before = Window.partitionBy(ASSET).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({name: c.over(before) for name, c in found.items()})


def joined(rows: DataFrame, blocks: DataFrame, name: str = "_block") -> DataFrame:
    """Rows with what is known of their block."""
    to = blocks.withColumnsRenamed({ASSET: "_of", name: "_in"})
    return rows.join(to, F.col(ASSET).eqNullSafe(F.col("_of")) & (F.col(name) == F.col("_in"))).drop("_of", "_in")
