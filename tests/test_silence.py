"""A stream in which an asset stops and comes back."""

from __future__ import annotations

from datetime import datetime, timedelta

from tidemark.streaming import silence

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_an_asset_that_stops_and_comes_back(spark, tmp_path):
    schema = "asset_id string, timestamp timestamp"
    batches = [
        [("a", m) for m in range(0, 11)] + [("b", m) for m in range(0, 11)] + [(None, 5)],
        [("b", m) for m in range(11, 61)],
        [("b", m) for m in range(61, 81)] + [("a", 80)],
        [("b", m) for m in range(81, 101)] + [("a", 100)],
        [("b", 101)],
    ]

    def run(n):
        for i in n:
            spark.createDataFrame([(a, at(m)) for a, m in batches[i]], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = silence.changes(rows, limit_minutes=30, lateness="5 minutes")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["asset_id"], r["change"], r["since"], r["until"]) for r in spark.read.schema(silence.CHANGES).parquet(str(tmp_path / "out")).collect())

    assert run([0, 1]) == [("a", "silent", at(10), at(40))]
    # goes on from its checkpoint: what was told is not told again
    assert run([2, 3, 4]) == [("a", "back", at(10), at(80)), ("a", "silent", at(10), at(40))]
