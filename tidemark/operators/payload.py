"""Nested telemetry payloads to rows: ``{key: [{ts, value}]}`` and ``{data: {key: [[ts, value]]}}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "map<string, array<struct<ts: bigint, value: string>>>"
MESSAGE = "struct<cmdId: int, data: map<string, array<array<string>>>>"


def explode_points(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """The other columns, key, ts, value and ``at``, the place of a point in its payload; what is no payload gives no rows."""
    rows = payloads.withColumn("_points", F.from_json(F.col(text), POINTS)).drop(text)
    rows = rows.select("*", F.explode("_points").alias("key", "_list")).drop("_points")
    return rows.select("*", F.posexplode("_list").alias("at", "_point")).select(*(c for c in rows.columns if c != "_list"), "at", "_point.ts", "_point.value")


def explode_messages(messages: DataFrame, text: str = "message") -> DataFrame:
    """timestamp_ms, key, value, datetime (UTC) and the other columns."""
    rows = messages.withColumn("_data", F.from_json(F.col(text), MESSAGE)["data"]).drop(text)
    rows = rows.select("*", F.explode("_data").alias("key", "_list")).drop("_data")
    rows = rows.select("*", F.explode("_list").alias("_point")).drop("_list")
    ms = F.try_element_at("_point", F.lit(1)).try_cast("bigint")
    return rows.select(
        *(c for c in rows.columns if c not in ("key", "_point")), ms.alias("timestamp_ms"), "key",
        F.try_element_at("_point", F.lit(2)).alias("value"), F.timestamp_millis(ms).alias("datetime"),
    )


def widen(points: DataFrame, keys: list[str], by: list[str], order: Column | str = "at") -> DataFrame:
    """One row per ``by`` and ts with a column for each key; of repeated points the last counts."""
    order = F.col(order) if isinstance(order, str) else order
    wide = points.withColumn("_order", order).groupBy(*by, "ts").pivot("key", sorted(keys)).agg(F.max_by("value", "_order"))
    return wide.select(*by, "ts", *sorted(keys))


def keys_of(payloads: DataFrame, text: str = "payload") -> list[str]:
    """The sorted keys that occur; a handful of names."""
    found = payloads.select(F.explode(F.map_keys(F.from_json(F.col(text), POINTS))).alias("key")).distinct()
    return sorted(r["key"] for r in found.toLocalIterator())
