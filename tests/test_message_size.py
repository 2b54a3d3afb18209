"""Messages do not grow with the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import telemetry


def test_messages_are_of_bounded_size(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    row = events.limit(1).drop("event_id")
    many = spark.range(5000).select(F.col("id").cast(events.schema["event_id"].dataType).alias("event_id")).crossJoin(row).select(events.columns)
    many.write.parquet(f"{tmp_path}/events.parquet")
    sizes = [r["n"] for r in telemetry._messages(spark, str(tmp_path)).select(F.regexp_count("message", F.lit(r'\],\[')).alias("n")).collect()]
    assert len(sizes) == 5 and sum(sizes) + len(sizes) == 5000 and max(sizes) < 1000
    assert telemetry.payload_explode(spark, str(tmp_path)).count() == 5000
