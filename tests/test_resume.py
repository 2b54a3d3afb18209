"""What is exported already is told without reading exported rows."""

from __future__ import annotations

import re

from tidemark.operators import calendar
from tidemark.sources import writers


def wide(spark, months):
    rows = [(f"i{a}", f"n{a}", a, 2024, m, 1000 * m + k, "1") for a, m in months for k in range(50)]
    return spark.createDataFrame(rows, "asset_id string, asset_name string, asset_label string, year int, month int, ts long, x string")


def done(spark, path):
    return sorted(map(tuple, writers.written(spark, path).collect()))


def test_lists_and_folders(spark, tmp_path):
    path = str(tmp_path / "o")
    assert writers.written(spark, path) is None
    writers.write_wide(wide(spark, [("A b", 1), ("A b", 2), ("C", 1)]), path, "g")
    folders = [("g", "A b", 2024, 1), ("g", "A b", 2024, 2), ("g", "C", 2024, 1)]
    assert done(spark, path) == folders  # an export without a list
    work = spark.createDataFrame([("A b", 2024, 1), ("D", 2024, 7)], "asset_label string, year int, month int")
    writers.mark_fetched(work, path, "g")
    assert done(spark, path) == sorted([*folders, ("g", "D", 2024, 7)])  # a month without rows is done too
    left = calendar.still_to_do(spark.createDataFrame([("C", 2024, 1), ("D", 2024, 7), ("D", 2024, 8)], "asset string, year int, month int"), writers.written(spark, path), ["asset", "year", "month"])
    assert left.collect() == [("D", 2024, 8)]


def test_rows_are_not_read(spark, tmp_path):
    path = str(tmp_path / "o")
    writers.write_wide(wide(spark, [("A", 1), ("B", 2)]), path, "g")
    for f in (tmp_path / "o").rglob("*.csv"):
        f.chmod(0)  # the names of folders do not need it; the plan says so for users whom that does not stop
    writers.mark_fetched(spark.createDataFrame([("A", 2024, 1)], "asset_label string, year int, month int"), path, "g")
    found = writers.written(spark, path)
    assert found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and re.search(r"binaryFile \[[^]]*content", plan) is None
