"""Ordered operators over blocks of time against plain loops over an asset's rows."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, recharge

DAY = datetime(2024, 2, 27)


@pytest.fixture(scope="module")
def made():
    """Assets whose days have from none to many rows; times repeat, levels too."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for asset, count, step in (("one", 1, 60), ("two", 2, 3000), ("sparse", 40, 1500), ("dense", 400, 9), ("mixed", 120, 0), (None, 30, 700)):
        at = 0
        for _ in range(count):
            at += int(rng.integers(0, step) if step else rng.choice([0, 1, 2, 5000, 1440 * 3]))
            rows.append((asset, DAY + timedelta(minutes=at), n, float(rng.integers(0, 30)) if rng.random() > 0.1 else None))
            n += 1
    return rows


def in_order(rows):
    out = {}
    for a, t, n, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        if v is not None:
            out.setdefault(a, []).append((t, n, v))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "asset_id string, timestamp timestamp_ntz, n int, nivelPorcentual double").repartition(3)


@pytest.mark.parametrize("block", ["hour", "day", "month"])
def test_neighbours(spark, made, block):
    rows = frame(spark, made).where("nivelPorcentual IS NOT NULL").withColumnRenamed("nivelPorcentual", "v")
    got = {(r["asset_id"], r["n"]): r for r in blocks.neighbours(rows, "v", 3, ["timestamp", "n"], block, place="i").collect()}
    want = in_order(made)
    assert len(got) == sum(map(len, want.values()))
    for a, series in want.items():
        v = [None] * 3 + [x for _, _, x in series] + [None] * 3
        for i, (_, n, _) in enumerate(series):
            r = got[a, n]
            assert [r["i"], *(r[f"_b{k}"] for k in (1, 2, 3)), *(r[f"_a{k}"] for k in (1, 2, 3))] == [i + 1, *v[i : i + 3][::-1], *v[i + 4 : i + 7]]


@pytest.mark.parametrize("width", [1, 3, 5, 9])
def test_rolling_median_and_turning_points(spark, made, width):
    rows, half = frame(spark, made), width // 2
    smooth = {(r["asset_id"], r["n"]): (r["i"], r["v"]) for r in recharge.smoothed(rows, width=width, tiebreak=("n",)).collect()}
    marks = {(r["asset_id"], r["n"]): (r["v"], r["is_min"], r["is_max"]) for r in recharge.turning_points(rows, width=width, tiebreak=("n",)).collect()}
    two_steps = recharge.extrema(recharge.smoothed(rows, width=width, tiebreak=("n",)), rows_a_block=7).where("is_min OR is_max")
    assert {(r["asset_id"], r["n"]): (r["v"], r["is_min"], r["is_max"]) for r in two_steps.collect()} == marks
    for a, series in in_order(made).items():
        x = [v for _, _, v in series]
        v = [float(np.median(x[max(0, i - half) : i + half + 1])) for i in range(len(x))]
        for i, (_, n, _) in enumerate(series):
            assert smooth.pop((a, n)) == (i + 1, v[i])
            low = 0 < i < len(v) - 1 and v[i - 1] > v[i] <= v[i + 1]
            high = 0 < i < len(v) - 1 and v[i - 1] < v[i] >= v[i + 1]
            assert marks.pop((a, n), (v[i], False, False)) == (v[i], low, high)
    assert not smooth and not marks


def greedy(series, width, amplitude, minutes):
    """Pairs by the loop: each minimum in order takes the first unused maximum after it."""
    x, half = [v for _, _, v in series], width // 2
    v = [float(np.median(x[max(0, i - half) : i + half + 1])) for i in range(len(x))]
    inner = range(1, len(v) - 1)
    minima = [i for i in inner if v[i - 1] > v[i] <= v[i + 1]]
    maxima = [i for i in inner if v[i - 1] < v[i] >= v[i + 1]]
    out, j = [], 0
    for i in minima:
        while j < len(maxima) and maxima[j] <= i:
            j += 1
        if j == len(maxima):
            break
        k, j = maxima[j], j + 1
        if v[k] - v[i] >= amplitude and series[k][0] - series[i][0] >= timedelta(minutes=minutes):
            out.append((series[i][0], series[k][0], v[i], v[k]))
    return out


@pytest.mark.parametrize("block", ["hour", "day", "year"])
def test_recharge_events(spark, made, block):
    got = recharge.recharge_events(frame(spark, made), width=3, min_amplitude=3.0, min_minutes=10.0, tiebreak=("n",), block=block).collect()
    want = [(str(a), *e) for a, s in in_order(made).items() for e in greedy(s, 3, 3.0, 10.0)]
    assert sorted((str(r["asset_id"]), r["start_time"], r["end_time"], r["level_start"], r["level_end"]) for r in got) == sorted(want) and len(want) > 40


def test_one_asset_with_all_rows(spark):
    """Only ends of days and a row for each day are ordered over the asset; its rows are dealt by day."""
    n = 60_000
    rows = spark.range(n).selectExpr("'a' AS asset_id", "timestamp_seconds(id * 60)::timestamp_ntz AS timestamp", "50 + 45 * sin(id / 300D) AS nivelPorcentual")
    rows = rows.withColumn("asset_id", F.format_string("a%d", F.floor(F.col("nivelPorcentual") / 1000)))  # no constant, which plans leave out
    plan = recharge.smoothed(rows)._jdf.queryExecution().sparkPlan().toString().splitlines()
    over_asset = [i for i, line in enumerate(plan) if re.search(r"Window .*, \[asset_id#\d+\], ", line)]
    assert over_asset and all("_at#" in plan[i + 1] + plan[i + 2] and "Filter" in plan[i + 1] + plan[i + 2] for i in over_asset)  # of ends only
    ends = blocks.with_block(rows).groupBy("asset_id", "_block").count().agg(F.sum(F.least("count", F.lit(4)))).first()[0]
    assert ends == 4 * 42
    events = recharge.recharge_events(rows)
    whole = recharge.recharge_events(rows, block="year")
    assert events.exceptAll(whole).isEmpty() and events.count() == whole.count() > 20


def test_without_rows(spark):
    empty = frame(spark, [("a", DAY, 1, None)])
    assert recharge.smoothed(empty).collect() == [] and recharge.recharge_events(empty).collect() == []
