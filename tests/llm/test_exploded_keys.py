"""Keys that are many times their file are not broadcast."""

from __future__ import annotations

from tidemark.llm import simhash


def test_keys_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """Spark sees 28 keys of each fingerprint as no larger than the file, so far below its limit."""
    spark.range(2000).selectExpr("xxhash64(id) AS fp").write.parquet(str(tmp_path / "fps"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan, plan
    assert found.count() == 0
    final = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in final, final
