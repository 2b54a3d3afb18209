"""Dense numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sampling


def test_numbers(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"), F.concat(F.lit("k"), "id").alias("k")).repartition(7)
    got = sampling.numbered(rows, ["x", "k"]).collect()
    assert [r["number"] for r in sorted(got, key=lambda r: r["x"])] == list(range(1, 5001)) and got[0].asDict().keys() == {"x", "k", "number"}
    assert sampling.numbered(rows.limit(0), ["x"]).collect() == []


def test_assets_in_order_of_appearance(spark):
    rows = spark.createDataFrame([(f"a{i * 37 % 300}", i, i) for i in range(3000)] + [(None, 0, 0)], "asset string, t int, n int")
    table = sampling.aliases(rows, "asset", ["t", "n"])
    assert {r["asset"]: r["alias"] for r in table.collect()} == {f"a{i * 37 % 300}": f"ASSET_{i + 1:03d}" for i in range(300)}
    few = sampling.first_assets(rows, "asset", 2, ["t", "n"])
    for df in (table, few):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["asset"] for r in few.collect()} == {"a0", "a37"}
