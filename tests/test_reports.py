"""Every table of the reports, and the catalog command."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from tidemark import __main__ as cli
from tidemark.operators import reports

from .test_rest import url  # noqa: F401

DAY = datetime(2024, 1, 30)


def series(spark):
    rows = [("A", DAY + timedelta(hours=h), float(h % 7), 1.0) for h in range(80) if h != 5] + [("A", DAY, 1.0, 1.0)]
    rows += [("B", DAY + timedelta(hours=h), None, float(h)) for h in range(10)] + [("late", DAY + timedelta(days=90), 1.0, 1.0)]
    return spark.createDataFrame(rows, "asset_id string, timestamp timestamp_ntz, nivelPorcentual double, nivelEstanque double")


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


FILES = [("f1", "epoch_ms", 3, 0), ("f2", "string", 2, 1)]


def test_integrity_tables(spark):
    files = spark.createDataFrame(FILES, "file string, strategy string, n_rows int, n_invalid int")
    t = reports.integrity_report(series(spark), 60, None, datetime(2024, 3, 1), None, files, {"group": "g", "input": "in", "output": "out"})
    assert set(t) == {"Summary", "Gaps", "Duplicates", "DuplicateExamples", "Monthly", "MonthlyPivot", "NoRows", "Notes"}
    assert collected(t["NoRows"]) == [("late",)]
    assert collected(t["DuplicateExamples"]) == [("A", "2024-01-30 00:00:00")] and collected(t["Duplicates"]) == [("A", DAY, 2)]
    monthly = {(r["asset"], r["month"]): r["missing_pct"] for r in t["Monthly"].collect()}
    pivot = {r["month"]: r.asDict() for r in t["MonthlyPivot"].collect()}
    assert set(pivot) == {"2024-01", "2024-02"} and all(pivot[m][a] == monthly.get((a, m), 0.0) for m in pivot for a in "AB") and ("B", "2024-02") not in monthly
    notes = dict(t["Notes"].collect())
    assert notes["timestamp_strategy"] == "mixed" and notes["timestamp_strategies"] == "epoch_ms, string" and notes["group"] == "g" and notes["input"] == "in" and notes["output"] == "out"
    assert datetime.strptime(notes["run_at"], "%Y-%m-%d %H:%M:%S") and notes["freq_minutes"] == "60" and notes["end"] == "2024-03-01 00:00:00" and notes["version"]
    assert len(t["Gaps"].collect()) == 1 and {r["asset"] for r in t["Summary"].collect()} == {"A", "B"}


def test_no_pivot_of_one_month_or_of_very_many_assets(spark, monkeypatch):
    assert "MonthlyPivot" not in reports.integrity_report(series(spark).where("asset_id = 'B'"), 60)
    monkeypatch.setattr(reports, "PIVOT_ASSETS", 1)
    t = reports.integrity_report(series(spark), 60)
    assert "MonthlyPivot" not in t and "more than 1 assets" in dict(t["Notes"].collect())["monthly_pivot"]


def test_tank_tables(spark):
    files = spark.createDataFrame(FILES[:1], "file string, strategy string, n_rows int, n_invalid int")
    t = reports.tank_report(series(spark), 4, None, datetime(2024, 3, 1), "a|b|l", ("nivelEstanque",), files, {"group": "g"})
    assert set(t) == {"Summary", "Percentiles", "Hist_nivelPorcentual", "RechargeEvents", "AmplitudeHistogram", "Correlation", "Scatter", "NoRows", "Notes"}
    assert collected(t["NoRows"]) == [("late",)]
    notes = dict(t["Notes"].collect())
    assert notes["timestamp_strategy"] == "epoch_ms" and notes["no data: nivelPorcentual"] == "B" and notes["group"] == "g" and notes["asset"] == "a|b|l"
    assert {r["asset_id"] for r in t["Summary"].collect()} == {"A", "B"} and t["Percentiles"].count() == 2 * 2 * 9
    assert t["Hist_nivelPorcentual"].count() == 4 and t["Scatter"].count() == 80 and t["Correlation"].count() == 1
    t["RechargeEvents"].collect(), t["AmplitudeHistogram"].collect()


def test_catalog_command(spark, tmp_path, url):  # noqa: F811
    entity = lambda i, name: {"entityId": {"entityType": "ASSET", "id": i}, "latest": {"ENTITY_FIELD": {"label": {"value": name.upper()}, "name": {"value": name}}}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"cmdId": 1, "data": {"data": [entity("z1", "zeta"), entity("a00", "old")], "hasNext": False}}))
    (tmp_path / "in" / "2.json").write_text(json.dumps({"any": [{"entityId": {"id": "w"}, "label": "walk", "entityType": "ASSET", "type": "Pozo"}], "assetTypes": [" Tanque ", 3]}))
    (tmp_path / "in" / "3.json").write_text("no json")
    (tmp_path / "h.json").write_text('{"X-Authorization": "me"}')
    cli.main(["catalog", "--url", url, "--asset-type", "Pumps", "--headers", str(tmp_path / "h.json"), "--messages", str(tmp_path / "in"), "--output", str(tmp_path / "o")])
    rows = [tuple(r) for r in spark.read.csv(str(tmp_path / "o" / "assets"), header=True).collect()]
    assert ("ZETA", "z1", "zeta", None) in rows and ("walk", "w", "walk", None) in rows and ("n0", "a00", "n0", "Pumps") in rows
    assert [r[0].lower() for r in rows] == sorted(r[0].lower() for r in rows) and len({r[1] for r in rows}) == len(rows)
    assert [r["type"] for r in spark.read.csv(str(tmp_path / "o" / "types"), header=True).collect()] == ["Pozo", "Pumps", "Tanque"]
