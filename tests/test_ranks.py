"""Order statistics by counts against sorted values."""

from __future__ import annotations

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, ranks

SPECIAL = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 0.1, 0.2, 1 / 3, 2.0**52, 2.0**53 + 2, 1e-300]


def test_codes_are_in_order(spark):
    rng = np.random.default_rng(1)
    around = [math.nextafter(2.0**e, to) for e in range(-1074, 1024, 7) for to in (-math.inf, math.inf)] + [2.0**e for e in range(-1074, 1024)]
    values = SPECIAL + around + [struct.unpack("<d", b.tobytes())[0] for b in rng.integers(-(2**63), 2**63 - 1, 3000, np.int64)]
    values = [v for v in values if not math.isnan(v)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", ranks.code("x").alias("c")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["c"] == (-bits if r["x"] < 0 else bits), r
    assert spark.createDataFrame([(math.nan,), (None,)], "x double").where(ranks.code("x").isNotNull()).isEmpty()


POINTS = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]


def wanted(values: list[float]) -> list[float]:
    s = sorted(values)
    out = []
    for p in POINTS:
        at = p * (len(s) - 1)
        low = math.floor(at)
        high = min(low + 1, len(s) - 1)
        out.append(s[low] if at == low else s[low] * (1 - (at - low)) + s[high] * (at - low))
    return out


def test_as_sorted(spark):
    rng = np.random.default_rng(2)
    lots = {
        "one": [3.25], "two": [1.0, 2.0], "same": [7.5] * 100, "near": (1 + rng.random(500) * 1e-12).tolist(), "wide": (rng.standard_normal(400) * 10.0 ** rng.integers(-200, 200, 400)).tolist(),
        "many": rng.integers(-20, 20, 3000).astype(float).tolist(), "special": SPECIAL[:10], None: [1.0, 5.0, 9.0],
    }
    rows = [(k, v) for k, vs in lots.items() for v in vs] + [("one", None), ("two", math.nan), ("none", None)]
    got = ranks.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", POINTS).collect()
    assert len(got) == len(lots) * len(POINTS)
    for r in got:
        assert r["value"] == pytest.approx(wanted(lots[r["k"]])[r["point"]], rel=1e-14, abs=0), r


def test_infinite_values_stay(spark):
    got = ranks.quantiles(spark.createDataFrame([(1, -math.inf), (1, 2.0), (1, math.inf)], "k int, v double"), ["k"], "v", [0.0, 0.5, 1.0]).orderBy("point")
    assert [r["value"] for r in got.collect()] == [-math.inf, 2.0, math.inf]


def test_one_asset_with_all_rows(spark):
    """Counts are what is shuffled and held: no buffer of values, no list, and far fewer counts than rows."""
    n = 200_000
    series = spark.range(n).selectExpr("'a' AS asset_id", "timestamp_seconds(id)::timestamp_ntz AS timestamp", "cast(id % 5003 AS double) / 7 AS nivelPorcentual", "cast(id * 7919 % 200000 AS double) AS nivelEstanque")
    table = profile.percentiles(series)
    got = {(r["variable"], r["percentile"]): r["value"] for r in table.collect()}
    assert got["nivelEstanque", "P50"] == (n - 1) / 2 and got["nivelPorcentual", "P99"] == pytest.approx(np.percentile(np.arange(n) % 5003 / 7, 99))
    stats = profile.stats(series)
    assert stats.first()["nivelEstanque_median"] == (n - 1) / 2
    for df in (table, stats):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and "percentile" not in plan.replace("percentile#", "").split("Initial Plan")[0].lower().replace("as percentile", "")
    near = spark.range(n).selectExpr("1 + id / (100D * 200000) AS x")  # all different, within a hundredth
    assert near.select(F.shiftright(ranks.code("x"), ranks.STEPS[0]).alias("p")).distinct().count() < 11_000
