"""Exact order statistics of very many values by counts alone.

The values of a key are never gathered or sorted.  Doubles are numbered in their
order by 64-bit codes, and the codes' leading bits are counted for each key.  Of
the counts only those that hold a wanted rank are gone into, by more bits of the
code, until all 64 are used and each count is one value (``STEPS``).  What is
shuffled are counts, combined where rows are read, so a key with all rows of the
table is as good as many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the code that are not looked at yet after each step.  The values of an octave are 2^20 prefixes in the first.
STEPS = (32, 0)


def code(x: str) -> Column:
    """A LONG for a DOUBLE column, in the same order: the bits of its absolute value, negated for negative ones; NULL for NULL and NaN."""
    near = f"greatest(floor(log2(abs({x}))), -1022L)"
    # rounding of the logarithm may be one off
    exponent = f"greatest(least(CASE WHEN pow(2D, {near}) > abs({x}) THEN {near} - 1 WHEN pow(2D, {near} + 1) <= abs({x}) THEN {near} + 1 ELSE {near} END, 1023L), -1022L)"
    bits = f"({exponent} + 1022) * {1 << 52}L + CAST(abs({x}) / pow(2D, {exponent}) * {1 << 52}D AS LONG)"
    return F.expr(f"CASE WHEN isnan({x}) THEN NULL WHEN {x} = 0 THEN 0L ELSE CAST(sign({x}) AS LONG) * CASE WHEN abs({x}) = double('inf') THEN {2047 << 52}L ELSE {bits} END END")


def quantiles(rows: DataFrame, keys: list[str], value: str, points: list[float]) -> DataFrame:
    """keys, point (its place in ``points``, from 0) and value: exact quantiles with linear interpolation, for keys with a value.

    NULL and NaN are no values; a NULL key is a key.
    """
    rows = rows.select(*keys, F.col(value).cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)").withColumn("_code", code("_x"))
    held, wanted = list(keys), None
    for left in STEPS:
        if wanted is not None:
            to = wanted.withColumnsRenamed({c: f"_to_{c}" for c in held})
            rows = rows.join(to, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_to_{c}")) for c in held)))
        column, given = f"_p{left}", ["_wanted"] if wanted is not None else []
        rows = rows.select(*held, *given, F.expr(f"shiftright(_code, {left}) AS {column}"), "_x", "_code")
        counts = rows.groupBy(*held, *given, column).agg(F.count("*").alias("_n"), F.max("_x").alias("_value"))
        group = Window.partitionBy(*held)
        counts = counts.withColumn("_until", F.sum("_n").over(group.orderBy(column)))
        if wanted is None:
            # few counts hold a rank: the others go before ranks are listed for each
            counts = counts.withColumn("_total", F.sum("_n").over(group)).where(_holds_any(points)).withColumn("_wanted", F.expr(_ranks(points)))
        # the ranks that lie in a count, and where in it
        inside = F.expr("transform(filter(_wanted, w -> w.rank >= _until - _n AND w.rank < _until), w -> named_struct('point', w.point, 'share', w.share, 'rank', w.rank - _until + _n)) AS _wanted")
        rows = rows.select(*held, column, "_x", "_code")
        held = [*held, column]
        wanted = counts.select(*held, inside, *(["_value"] if left == 0 else [])).where("size(_wanted) > 0")
    parts = wanted.select(*keys, "_value", F.explode("_wanted").alias("w")).where("w.share > 0")
    return parts.groupBy(*keys, F.col("w.point").alias("point")).agg(F.expr("sum(_value * w.share) AS value"))


def _holds_any(points: list[float]) -> str:
    """Whether a count holds one of the ranks next to any point."""
    at = [f"({float(p)!r}D * (_total - 1))" for p in points]
    return " OR ".join(f"(floor({a}) < _until AND floor({a}) + 1 >= _until - _n)" for a in at) or "false"


def _ranks(points: list[float]) -> str:
    """The two ranks around each point and their shares; the share of the second is 0 where the first is met."""
    at = [f"({float(p)!r}D * (_total - 1))" for p in points]
    one = "named_struct('point', {i}, 'share', {share}, 'rank', {rank})"
    low = [one.format(i=i, share=f"1 - ({a} - floor({a}))", rank=f"floor({a})") for i, a in enumerate(at)]
    high = [one.format(i=i, share=f"{a} - floor({a})", rank=f"least(floor({a}) + 1, _total - 1)") for i, a in enumerate(at)]
    return f"array({', '.join(low + high)})"
