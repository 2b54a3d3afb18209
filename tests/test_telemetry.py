"""Telemetry operators: hand-computed cases, properties against plain Python, and SQL."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import bounds, scalars
from tidemark.operators import calendar, catalog, integrity, payload, profile, recharge, reports, sampling
from tidemark.plans import telemetry
from tidemark.roles import find_column, level_columns
from tidemark.sources import csvs, writers
from tidemark.streaming import monitor

DATA = "/root/testdata/sf0.001"
DAY = datetime(2024, 1, 1)


def series(spark, rows):
    """rows: asset, minutes after DAY (or a time), levels."""
    out = [(a, DAY + timedelta(minutes=t) if not isinstance(t, datetime) else t, *(list(v) + [None, None])[:2], i) for i, (a, t, *v) in enumerate(rows)]
    return spark.createDataFrame(out, "asset_id string, timestamp timestamp_ntz, nivelPorcentual double, nivelEstanque double, n long")


def collected(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(telemetry.QUERIES))
def test_queries_agree_with_sql(spark, name):
    rows = telemetry.QUERIES[name](spark, DATA).toPandas()
    db = duckdb.connect()
    for t in ("events", "customer", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(telemetry.SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(rows.columns)
    plain = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert plain(rows) == plain(want) and len(want)


# --- integrity ---


def test_gap_threshold(spark):
    got = collected(integrity.gaps(series(spark, [("a", t) for t in (0, 1, 2.5, 5)]), 1).orderBy("gap_start"))
    assert [(r[3], r[4]) for r in got] == [(1.5, 0), (2.5, 1)]


def test_gaps_between_days_and_stable_top(spark):
    s = series(spark, [("a", 1440 * i) for i in range(13)])
    got = collected(integrity.gaps(s, 1).orderBy("gap_start"))
    assert len(got) == 10 and got[0][1] == DAY and all(r[3] == 1440 for r in got)


def test_duplicates_hide_missing(spark):
    s = series(spark, [("a", 0), ("a", 0), ("a", 2)])
    r = integrity.summary(s, 1).first()
    assert (r["obs"], r["expected"], r["missing_pct"], r["dup_count"], r["max_gap_minutes"]) == (3, 3, 0.0, 1, 2.0)
    assert collected(integrity.duplicates(s)) == [("a", DAY, 2)]


def test_known_series(spark):
    first = datetime(2024, 11, 1, 3)
    r = integrity.summary(series(spark, [("t", first + timedelta(minutes=i)) for i in range(500)]), 1).first()
    assert (r["expected"], r["missing_pct"]) == (500, 0.0)
    first = datetime(2025, 12, 1, 3)
    r = integrity.summary(series(spark, [("p", first + timedelta(minutes=i)) for i in range(503) if i not in (5, 6, 300)]), 1).first()
    assert (r["obs"], r["expected"], round(r["missing_pct"], 6)) == (500, 503, 0.596421)


def test_expected_is_slots_plus_missing(spark):
    rng = np.random.default_rng(0)
    minutes = sorted(rng.choice(5000, 900, replace=False).tolist())
    s = series(spark, [("a", t) for t in minutes])
    lost = integrity.gaps(s, 1, top=10_000).agg(F.sum("missing_points_est")).first()[0]
    assert integrity.summary(s, 1).first()["expected"] == len(minutes) + lost


def test_month_end(spark):
    s = series(spark, [("a", datetime(2024, 2, 1) + timedelta(hours=h)) for h in range(29 * 24)])
    r = integrity.monthly(s, 60).first()
    assert (r["month"], r["obs"], r["expected"], r["missing_pct"]) == ("2024-02", 28 * 24 + 1, 28 * 24 + 1, 0.0)
    r = integrity.monthly(s, 60, month_end="full").first()
    assert (r["obs"], r["expected"]) == (29 * 24, 29 * 24)


def test_bounds_and_filter(spark):
    assert bounds.parse_bound("2024-01-31", True, 1) == datetime(2024, 1, 31, 23, 59)
    assert bounds.parse_bound("2024-1-31", True, 1) == datetime(2024, 1, 31)
    assert bounds.parse_bound("x") is None and bounds.parse_bound(None) is None
    s = series(spark, [("Tank (A)", 0), ("Tank B", 1), (None, 2)])
    assert collected(integrity.bounded(s, asset="TANK (A)").select("asset_id")) == []
    assert collected(integrity.bounded(s, asset="tank b").select("asset_id")) == [("Tank B",)]
    assert integrity.bounded(s, DAY + timedelta(minutes=1), DAY + timedelta(minutes=1)).count() == 1


def test_empty_series(spark):
    s = series(spark, [])
    for tables in (reports.integrity_report(s, 1), reports.tank_report(s)):
        assert all(t.count() == 0 for k, t in tables.items() if k != "Notes")


# --- profile ---


def test_stats_of_one_value_and_of_none(spark):
    r = profile.stats(series(spark, [("a", 0, 5.0), ("b", 0)])).orderBy("asset_id").collect()
    assert (r[0]["nivelPorcentual_std"], r[0]["nivelPorcentual_median"], r[0]["nivelEstanque_n_valid"], r[0]["nivelEstanque_missing_pct"]) == (None, 5.0, 0, 100.0)
    assert r[1]["nivelPorcentual_min"] is None
    assert profile.percentiles(series(spark, [("b", 0)])).where("value IS NULL").count() == 18


def test_stats_and_percentiles_against_numpy(spark):
    x = np.random.default_rng(1).normal(50, 20, 333)
    s = series(spark, [("a", i, float(v)) for i, v in enumerate(x)])
    r = profile.stats(s).first()
    assert (r["nivelPorcentual_mean"], r["nivelPorcentual_std"], r["nivelPorcentual_median"]) == pytest.approx((x.mean(), x.std(ddof=1), np.median(x)))
    got = {p: v for _, _, p, v in collected(profile.percentiles(s, ("nivelPorcentual",)))}
    assert got == {f"P{p}": pytest.approx(np.percentile(x, p)) for p in profile.PERCENTILES}


def test_histogram_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(40):
        x = rng.choice([rng.integers(0, 30, 50) / 10, rng.normal(0, 1, 50)], p=[0.6, 0.4])
        rows += [(str(k), float(v)) for v in x]
        counts, edges = np.histogram(x, 7)
        want[str(k)] = list(zip(edges[:-1].round(9), counts, strict=True))
    rows += [("c", 5.0), ("c", 5.0), ("n", None)]
    want["c"] = [(4.5, 0), (4.75, 0)]
    got = {}
    for key, left, _, n in collected(profile.histogram(spark.createDataFrame(rows, "k string, x double"), "x", 7, ["k"]).orderBy("k", "bin_left")):
        got.setdefault(key, []).append((round(left, 9), n))
    assert got.pop("c")[3][1] == 2 and "n" not in got
    want.pop("c")
    assert got == want


def test_correlation_of_constants(spark):
    s = series(spark, [("y", i, float(i), 3.0) for i in range(4)] + [("x", i, 3.0, float(i)) for i in range(4)] + [("one", 0, 1.0, 1.0)] + [("line", i, float(i), 2.0 * i + 1) for i in range(5)])
    got = {r[0]: r[1:] for r in collected(profile.correlation(s))}
    assert got["y"] == (None, 0.0, 3.0, None) and got["x"] == (None, None, None, None) and "one" not in got
    assert got["line"] == pytest.approx((1.0, 2.0, 1.0, 1.0))


# --- recharge ---


def greedy(values, times, amplitude=10.0, minutes=30.0):
    v = pd.Series(values).rolling(5, center=True, min_periods=1).median().tolist()
    lows = [i for i in range(1, len(v) - 1) if v[i - 1] > v[i] <= v[i + 1]]
    highs = [i for i in range(1, len(v) - 1) if v[i - 1] < v[i] >= v[i + 1]]
    out, used = [], 0
    for i in lows:
        while used < len(highs) and highs[used] <= i:
            used += 1
        if used == len(highs):
            break
        j = highs[used]
        used += 1
        if v[j] - v[i] >= amplitude and times[j] - times[i] >= minutes:
            out.append((times[i], times[j], v[i], v[j]))
    return out


def test_recharge_against_a_loop(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for k in range(60):
        n = int(rng.integers(3, 80))
        x, t = rng.integers(0, 6, n) * 8.0, np.cumsum(rng.integers(1, 30, n)).tolist()
        rows += [(str(k), m, float(v)) for m, v in zip(t, x, strict=True)]
        want += [(str(k), *e) for e in greedy(x, t)]
    got = collected(recharge.recharge_events(series(spark, rows)))
    minute = lambda ts: (ts - DAY).total_seconds() / 60
    assert sorted((a, minute(s), minute(e), lo, hi) for a, s, e, _, lo, hi, _ in got) == sorted(want) and want


def test_smoothing_edges_and_plateaus(spark):
    s = series(spark, [("a", i, float(i)) for i in range(8)])
    assert [r["v"] for r in recharge.smoothed(s).orderBy("i").collect()] == [1, 1.5, 2, 3, 4, 5, 5.5, 6]
    flat = spark.createDataFrame([("a", i, v) for i, v in enumerate((5.0, 3.0, 3.0, 2.0, 2.0, 4.0), 1)], "asset_id string, i int, v double")
    assert [r["i"] - 1 for r in recharge.extrema(flat).where("is_min").orderBy("i").collect()] == [1, 3]


# --- scalars, calendar ---


def test_scalars(spark):
    df = spark.createDataFrame([(" a<b:c  d\t ", "short", 0.125), (None, "abcdefghijkl", 2.5), ("x\x01|y", None, 0.375)], "s string, k string, x double")
    got = collected(df.select(scalars.sanitize(F.col("s")), scalars.redact(F.col("k")), scalars.round_half_even(F.col("x"), 2)))
    assert got == [("a_b_c d", "***", 0.12), ("", "abcd...ijkl", 2.5), ("x_y", None, 0.38)]
    at = spark.range(1).select(scalars.epoch_ms(F.lit(datetime(2025, 12, 1)).cast("timestamp_ntz"), "America/Santiago").alias("ms"))
    assert at.first()["ms"] == 1764558000000
    nums = spark.createDataFrame([("12d",), ("1e3",), (" 7 ",), ("1e300",), ("",), (None,)], "c string").select(scalars.to_number(F.col("c")))
    assert [r[0] for r in nums.collect()] == [None, 1000.0, 7.0, 1e300, None, None]


@pytest.mark.parametrize(("unit", "strategy"), [(1, "epoch_s"), (1000, "epoch_ms"), (10**6, "epoch_us"), (None, "string")])
def test_epoch_units(spark, unit, strategy):
    cells = [str(1_700_000_000 * unit + i * unit) if unit else f"2023-11-14 22:13:2{i}" for i in range(5)] + ["bad", "1e300" if unit else "2023-13-01"]
    rows = csvs.parsed_times(spark.createDataFrame([(c, "f") for c in cells], "c string, _file string"), "c").orderBy("c").collect()
    assert {r["strategy"] for r in rows} == {strategy}
    good = sorted(r["timestamp"] for r in rows if r["timestamp"])
    assert good == [datetime(2023, 11, 14, 22, 13, 20) + timedelta(seconds=i) for i in range(5)]


def test_unit_is_that_of_the_median(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    groups = {f"g{i}": rng.choice([5.0, 1e8 - 2, 1e8, 1e8 + 4, 1e11, 3e11, 1e14], rng.integers(1, 8)).tolist() for i in range(60)}
    rows = spark.createDataFrame([(repr(x), g) for g, xs in groups.items() for x in xs], "c string, _file string")
    got = dict(collected(csvs.parsed_times(rows, "c").select("_file", "strategy").distinct()))
    unit = lambda m: next((n for n, at in scalars.EPOCH_UNITS if m >= at), "epoch_ns")
    assert got == {g: unit(np.median(xs)) for g, xs in groups.items()}


def test_months(spark):
    got = collected(calendar.month_spans(spark, "2025-01-20", "2025-02-10"))
    assert got == [(datetime(2025, 1, 1), datetime(2025, 1, 31, 23, 59, 59, 999000)), (datetime(2025, 2, 1), datetime(2025, 2, 10))]
    work = calendar.work_list(spark.createDataFrame([("a",), ("b",)], "asset string"), calendar.month_ranges(spark, "2024-12", "2025-01", "UTC"))
    assert work.count() == 4
    done = work.limit(1)
    assert calendar.still_to_do(work, done, ["asset", "year", "month"]).count() == 3
    assert calendar.still_to_do(work, done, ["asset", "year", "month"], overwrite=True).count() == 4


def test_names_and_settings(monkeypatch, tmp_path):
    assert find_column(["TS", "Datetime"], ("timestamp", "ts", "datetime")) == "TS"
    assert level_columns(["NIVELPORCENTUAL", "x"]) == {"nivelPorcentual": "NIVELPORCENTUAL"}
    assert bounds.name_list(" a, b,,a") == ["a", "b"] and bounds.name_list(None) == []
    monkeypatch.setenv("TIDEMARK_URL", "wss://x")
    assert bounds.Settings.from_env().zone == "UTC"
    monkeypatch.setenv("TIDEMARK_TIMEZONE", "Nowhere/None")
    with pytest.raises(ValueError):
        bounds.Settings.from_env()
    (tmp_path / "h.json").write_text(json.dumps({"A": "1"}))
    assert bounds.headers_from(str(tmp_path / "h.json")) == ["A: 1"] == bounds.request_headers(extra={"A": "1"})


# --- payloads and catalogs ---


def test_last_of_repeated_points_wins(spark):
    text = json.dumps({"b": [{"ts": 1, "value": "x"}, {"ts": 1, "value": "y"}], "a": [{"ts": 2, "value": "z"}]})
    points = payload.explode_points(spark.createDataFrame([("t", text), ("e", "{}"), ("n", "no json")], "asset string, payload string"))
    wide = payload.widen(points, ["b", "a"], ["asset"]).orderBy("ts")
    assert wide.columns == ["asset", "ts", "a", "b"] and collected(wide) == [("t", 1, None, "y"), ("t", 2, "z", None)]
    assert payload.keys_of(spark.createDataFrame([("t", text)], "asset string, payload string")) == ["a", "b"]


def test_messages(spark):
    text = json.dumps({"cmdId": 1, "data": {"k": [["1764558000000", "5"], [1764558060000, 6]]}})
    got = collected(payload.explode_messages(spark.createDataFrame([(text,), ("{}",)], "message string")).select("timestamp_ms", "key", "value"))
    assert got == [(1764558000000, "k", "5"), (1764558060000, "k", "6")]


def test_catalog(spark):
    entity = lambda i, label, name, kind="ASSET": {"entityId": {"entityType": kind, "id": i}, "latest": {"ENTITY_FIELD": {"label": {"value": label}, "name": {"value": name}}}}
    page = json.dumps({"data": {"data": [entity("1", "", "N"), entity("2", "L", ""), entity("3", "", ""), entity("4", "x", "x", "DEVICE"), entity("", "x", "x"), {"odd": 1}], "hasNext": False}})
    got = collected(catalog.extract_assets(spark.createDataFrame([(page,)], "message string")).select("id", "label", "name"))
    assert got == [("1", "N", "N"), ("2", "L", "L"), ("3", "3", "3")]
    listing = json.dumps({"data": [{"id": {"id": "1"}, "name": "n", "label": None}], "hasNext": True})
    assert collected(catalog.page_assets(spark.createDataFrame([(listing,)], "page string")).select("id", "name", "label")) == [("1", "n", None)]
    twice = spark.createDataFrame([("1", "a", 1), ("1", "b", 2)], "id string, label string, at int")
    assert collected(catalog.last_of_each(twice, "id", ["at"])) == [("1", "b", 2)]


def test_walks(spark):
    deep = {"x": [[{"y": {"entityId": {"id": "7"}, "label": "L", "entityType": "ASSET", "type": "T"}}], 5, None], "entityId": {"id": 9}, "name": "no text id"}
    texts = spark.createDataFrame([(json.dumps(deep),), ("broken {",), (None,)], "t string")
    assert collected(catalog.walk_entities(texts, "t")) == [("7", "L")]
    assert collected(catalog.walk_types(texts, "t")) == [("L", "T")]
    scraped = spark.createDataFrame([('..."assetTypes": ["A ", "B", 3, ""] "assetTypes":[oops] "assetTypes":["A"]',)], "t string")
    assert sorted(collected(catalog.asset_types(scraped, "t"))) == [("A",), ("B",)]


# --- sampling, reports, files ---


def test_sampling(spark):
    rows = series(spark, [("b", 0, 0.125), ("a", 1, 2.675), ("b", 2, 1.0), ("c", 3, 1.0)])
    assert dict(collected(sampling.aliases(rows, "asset_id", ["timestamp", "n"]))) == {"b": "ASSET_001", "a": "ASSET_002", "c": "ASSET_003"}
    assert sampling.first_assets(rows, "asset_id", 2, ["timestamp", "n"]).count() == 3
    assert sampling.head(rows, 1, ["timestamp"], "asset_id").count() == 3 and sampling.head(rows, 2, ["timestamp"]).count() == 2 and sampling.head(rows, 0, ["timestamp"]).count() == 4
    assert sampling.rounded(rows, 2).first()["nivelPorcentual"] == 0.12
    m = sampling.manifest(rows, "timestamp", "asset_id", {"head": "2"}).first()
    assert m["rows_per_asset"] == {"a": 1, "b": 2, "c": 1} and m["assets_included"] == ["a", "b", "c"] and m["parameters"] == {"head": "2"}
    assert sampling.manifest(rows, "timestamp").first()["rows_per_asset"] == {"ALL": 4}


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_csv_series_with_unlike_headers(spark, tmp_path):
    write(tmp_path / "Tank 1" / "a_2024.csv", "asset_label,ts,nivelEstanque,nivelPorcentual\nT1,1700000000000,1.5,10\n ,1700000060000,NA,11\nT1,bad,1,1\n")
    write(tmp_path / "Tank+2" / "b_2024.csv", "TS,NivelPorcentual\n1700000000,7\n1700000060,12d\n")
    write(tmp_path / "x" / "none.csv", "foo,bar\n1,2\n")
    write(tmp_path / "x" / "empty.csv", "")
    write(tmp_path / "x" / "lost.csv", "ts\nnever\n")
    write(tmp_path / "x" / "head.csv", "ts,nivelPorcentual\n")
    write(tmp_path / "Twice" / "twice_1.csv", "ts,x,X,nivelPorcentual\n1700000000,a,b,5\n")
    scan = csvs.read_series(spark, str(tmp_path))
    rows = sorted(collected(scan.rows.select("asset_id", "timestamp", "nivelPorcentual", "nivelEstanque")))
    t = datetime(2023, 11, 14, 22, 13, 20)
    assert rows == [("T1", t, 10.0, 1.5), ("Tank 1", t + timedelta(minutes=1), 11.0, None), ("Tank+2", t, 7.0, None), ("Tank+2", t + timedelta(minutes=1), None, None), ("Twice", t, 5.0, None)]
    files = {f.rsplit("/", 1)[1]: (s, n, bad) for f, s, n, bad, _ in collected(scan.files)}
    assert files == {"a_2024.csv": ("epoch_ms", 3, 1), "b_2024.csv": ("epoch_s", 2, 0), "twice_1.csv": ("epoch_s", 1, 0)}
    skipped = {f.rsplit("/", 1)[1]: why for f, why in collected(scan.skipped)}
    assert skipped == {"none.csv": "no time column", "empty.csv": "empty", "lost.csv": "no readable time", "head.csv": "no rows, or corrupt ones"}
    assert reports.strategy(scan.files).first()["strategy"] == "mixed"
    empty = tmp_path / "nothing"
    empty.mkdir()
    assert csvs.read_series(spark, str(empty)).rows.count() == 0


def test_sample_input(spark, tmp_path):
    (tmp_path / "in.csv").write_text("bomba,FechaHora,x\nP,2024-01-01 00:00:00,1\n")
    rows, time, asset = csvs.read_sample_input(spark, str(tmp_path / "in.csv"))
    assert (time, asset, rows.first()["timestamp"]) == ("FechaHora", "bomba", DAY)
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        csvs.read_sample_input(spark, str(tmp_path / "bad.csv"))


def test_wide_files_and_resume(spark, tmp_path):
    wide = spark.createDataFrame([("1", "n", "L/1", 2024, 1, 5, "a"), ("1", "n", "L/1", 2024, 2, 6, "b")], "asset_id string, asset_name string, asset_label string, year int, month int, ts long, k string")
    out = str(tmp_path / "out")
    writers.write_wide(wide.where("month = 1"), out, "g")
    writers.write_wide(wide.where("month = 2"), out, "g")
    assert sorted(collected(writers.written(spark, out))) == [("g", "L_1", 2024, 1), ("g", "L_1", 2024, 2)]
    writers.write_wide(wide.where("month = 1").withColumn("k", F.lit("new")), out, "g")
    writers.mark_fetched(wide.where("month = 2").withColumn("month", F.lit(3)), out, "g")
    assert writers.written(spark, out).count() == 3 and writers.written(spark, str(tmp_path / "none")) is None
    assert sorted(r["k"] for r in spark.read.csv(out, header=True).collect()) == ["b", "new"]


def test_reports_and_catalog_files(spark, tmp_path):
    s = series(spark, [("a", i * 20, float((i % 7) * 10), float(i)) for i in range(60)])
    writers.write_report(reports.integrity_report(s, 20), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "Summary")).first()["expected"] == 60
    writers.write_report(reports.tank_report(s), str(tmp_path / "t"), "csv")
    assert spark.read.csv(str(tmp_path / "t" / "Percentiles"), header=True).count() == 18
    writers.write_catalog(catalog.catalog(spark.createDataFrame([("1", 'b "q"', "n"), ("2", "A", "n")], "id string, label string, name string")), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first()["asset_label"] == "A"
    writers.write_manifest(sampling.manifest(s, "timestamp", "asset_id"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    writers.write_samples(s, str(tmp_path / "s"), "asset_id")
    writers.write_long(payload.explode_messages(spark.createDataFrame([('{"data": {"k": [["1", "2"]]}}',)], "message string")), str(tmp_path / "l"))
    assert writers.run_stamp(spark, "wss://x").first()["ws_url"] == "wss://x"


def test_stream_equals_batch(spark, tmp_path):
    schema = T.StructType([T.StructField("asset_id", T.StringType()), T.StructField("timestamp", T.TimestampNTZType()), T.StructField("value", T.DoubleType())])
    src = str(tmp_path / "in")
    rows = [("a", DAY + timedelta(minutes=7 * i), float(i)) for i in range(100)] + [("z", DAY + timedelta(days=9), 0.0)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    monitor.stream_to(stream, "value", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    want = monitor.completeness(spark.read.parquet(src), "value").where("asset_id = 'a'")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(collected(got)) == sorted(collected(want))
