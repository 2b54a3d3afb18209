"""The command line, the driver's contract and independence of the training-data operators."""

from __future__ import annotations

import ast
from pathlib import Path

import pytest

import __spark_entry__
from tidemark import __main__ as cli

from .test_rest import url  # noqa: F401
from .test_telemetry import write

ROOT = Path(__file__).parent.parent


def test_reports(spark, tmp_path):
    text = "asset_label,ts,nivelPorcentual,nivelEstanque\n" + "".join(f"T,{1_700_000_000_000 + 1_200_000 * i},{(i % 9) * 10},{i}\n" for i in range(90))
    write(tmp_path / "in" / "T" / "T_2023-11.csv", text)
    cli.main(["integrity", "--input-dir", str(tmp_path / "in"), "--group", "estanques", "--freq-minutes", "20", "--output", str(tmp_path / "i")])
    assert spark.read.parquet(str(tmp_path / "i" / "Summary")).first()["missing_pct"] == 0
    cli.main(["tanks", "--input-dir", str(tmp_path / "in"), "--output", str(tmp_path / "t"), "--format", "csv", "--end-date", "2023-11-15"])
    assert spark.read.csv(str(tmp_path / "t" / "RechargeEvents"), header=True).count() > 0
    with pytest.raises(SystemExit):
        cli.main(["integrity", "--input-dir", "x", "--output", "y", "--all", "--asset", "z"])


def test_sample(spark, tmp_path):
    (tmp_path / "in.csv").write_text("asset_label,asset_name,ts,x\n" + "".join(f"{'BA'[i % 2]},n,{1_700_000_000_000 + i},0.125\n" for i in range(10)))
    cli.main(["sample", "--input", str(tmp_path / "in.csv"), "--out-dir", str(tmp_path / "o"), "--group", "g", "--max-rows", "3", "--round", "2", "--drop-identifiers"])
    rows = spark.read.csv(str(tmp_path / "o" / "sample_g"), header=True).collect()
    assert len(rows) == 6 and {r["asset_label"] for r in rows} == {"ASSET_001", "ASSET_002"} and {r["x"] for r in rows} == {"0.12"} and "asset_name" not in rows[0]
    assert spark.read.json(str(tmp_path / "o" / "manifest")).first()["rows_per_asset"]["ASSET_001"] == 3


def test_export_and_resume(spark, tmp_path, url):  # noqa: F811
    (tmp_path / "h.json").write_text('{"X-Authorization": "me"}')
    given = ["export", "--url", url, "--start-ym", "2024-01", "--outdir", str(tmp_path / "o"), "--only", "n0", "--asset-type", "bombas=Pumps", "--headers", str(tmp_path / "h.json")]
    assert cli.export(spark, cli.arguments([*given, "--end-ym", "2024-01"])) == 6  # three assets of two groups
    rows = spark.read.csv(str(tmp_path / "o"), header=True)
    n = rows.count()
    # one asset has no points: its months leave no rows but count as fetched
    assert n == 2 * 2 * 4 and {r["asset"] for r in rows.collect()} == {"n0"}
    assert cli.export(spark, cli.arguments([*given, "--end-ym", "2024-01", "--resume"])) == 0
    assert cli.export(spark, cli.arguments([*given, "--end-ym", "2024-02", "--resume", "--groups", "bombas"])) == 3
    assert cli.export(spark, cli.arguments([*given, "--end-ym", "2024-01"])) == 6  # again: replaced, not doubled
    assert spark.read.csv(str(tmp_path / "o"), header=True).where("month = 1").count() == n


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_training_data_operators():
    for path in (ROOT / "tidemark").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
