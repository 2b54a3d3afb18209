"""Asset catalogs out of nested JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import label_or_name_or_id

VALUE = "struct<value: string>"
ENTITIES = f"""struct<cmdId: int, data: struct<data: array<struct<
    entityId: struct<entityType: string, id: string>,
    latest: struct<ENTITY_FIELD: struct<label: {VALUE}, name: {VALUE}>>>>, hasNext: boolean>>"""
PAGE = "struct<data: array<struct<id: struct<id: string>, name: string, label: string>>, hasNext: boolean>"
# Fixed value: what a list of types looks like in a message.
TYPE_LIST = r'"assetTypes"\s*:\s*(\[[^\]]*\])'


def try_json(text: Column) -> Column:
    """A variant, NULL where the text is no JSON."""
    return F.try_parse_json(text)


def extract_assets(messages: DataFrame, text: str = "message") -> DataFrame:
    """id, label, name and ``at`` of every entity of type ASSET with an id; a missing name or label is filled by the other, then the id."""
    rows = messages.select(*(c for c in messages.columns if c != text), F.posexplode(F.from_json(F.col(text), ENTITIES)["data"]["data"]).alias("at", "e"))
    rows = rows.where("e.entityId.entityType = 'ASSET' AND e.entityId.id <> ''")
    id_, label, name = (F.col(f"e.{c}") for c in ("entityId.id", "latest.ENTITY_FIELD.label.value", "latest.ENTITY_FIELD.name.value"))
    keep = [c for c in rows.columns if c != "e"]
    return rows.select(*keep, id_.alias("id"), label_or_name_or_id(label, name, id_).alias("label"), label_or_name_or_id(name, label, id_).alias("name"))


def page_assets(pages: DataFrame, text: str = "page") -> DataFrame:
    """id, name, label and ``at`` of the entries of listing pages."""
    rows = pages.select(*(c for c in pages.columns if c != text), F.posexplode(F.from_json(F.col(text), PAGE)["data"]).alias("at", "e"))
    return rows.select(*(c for c in rows.columns if c != "e"), F.col("e.id.id").alias("id"), "e.name", "e.label")


def last_of_each(assets: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in ``order``."""
    rest = [c for c in assets.columns if c != key]
    rows = assets.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return rows.select(*(F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in assets.columns))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Rows and levels that a walk may have; Spark's own limits are made for hand-written recursion.
WALK_LIMITS = {"spark.sql.cteRecursionRowLimit": "-1", "spark.sql.cteRecursionLevelLimit": "-1"}


def walked(texts: DataFrame, text: str) -> DataFrame:
    """Every object in JSON texts, at any depth: the other columns and ``node`` (variant).

    A recursive query: each step has the objects and lists right below those of the step before, and ends where there are
    none.  The session's limits of recursion are lifted.  What is no JSON gives no rows.
    """
    spark = texts.sparkSession
    for name, value in WALK_LIMITS.items():
        spark.conf.set(name, value)
    keep = [_quoted(c) for c in texts.columns if c != text]
    names = ", ".join([*keep, "node"])
    found = spark.sql(
        f"""WITH RECURSIVE walk({names}) AS (
            SELECT {', '.join([*keep, f'try_parse_json({_quoted(text)})'])} FROM {{texts}} WHERE try_parse_json({_quoted(text)}) IS NOT NULL
            UNION ALL
            SELECT {', '.join([*(f'walk.{c}' for c in keep), 'below.value'])} FROM walk, LATERAL variant_explode(walk.node) AS below
            WHERE schema_of_variant(below.value) LIKE 'OBJECT%' OR schema_of_variant(below.value) LIKE 'ARRAY%')
        SELECT {names} FROM walk""",
        texts=texts,
    )
    return found.where(F.schema_of_variant("node").like("OBJECT%"))


def _text(path: str) -> Column:
    """A string at a path of ``node``; NULL for other types."""
    return F.when(F.schema_of_variant(F.try_variant_get("node", path, "variant")) == "STRING", F.try_variant_get("node", path, "string"))


def walk_entities(texts: DataFrame, text: str) -> DataFrame:
    """Objects with entityId.id and a name, label or entityName: the other columns, id, name."""
    nodes = walked(texts, text)
    keep = [c for c in nodes.columns if c != "node"]
    name = F.coalesce(*(F.nullif(_text(p), F.lit("")) for p in ("$.name", "$.label", "$.entityName")))
    return nodes.select(*keep, _text("$.entityId.id").alias("id"), name.alias("name")).where("id <> '' AND name IS NOT NULL")


def walk_types(texts: DataFrame, text: str) -> DataFrame:
    """Distinct name, type of objects with entityType ASSET that have both as strings."""
    nodes = walked(texts, text).where(_text("$.entityType") == "ASSET")
    pick = lambda a, b: F.coalesce(F.nullif(_text(a), F.lit("")), F.nullif(_text(b), F.lit("")))
    return nodes.select(pick("$.name", "$.label").alias("name"), pick("$.type", "$.assetType").alias("type")).na.drop().distinct()


def asset_types(texts: DataFrame, text: str) -> DataFrame:
    """Distinct types in every ``"assetTypes": [...]`` of the texts; lists that are no JSON and non-strings are skipped."""
    lists = texts.select(F.explode(F.regexp_extract_all(text, F.lit(TYPE_LIST), F.lit(1))).alias("found"))
    items = lists.select(F.explode(F.from_json("found", "array<variant>", {"mode": "PERMISSIVE"})).alias("item"))
    named = F.when(F.schema_of_variant("item") == "STRING", F.trim(F.try_variant_get("item", "$", "string")))
    return items.select(named.alias("type")).where("type <> ''").distinct()


def catalog(assets: DataFrame) -> DataFrame:
    """asset_label, asset_id, asset_name, asset_type sorted by label regardless of case."""
    kind = F.col("type") if "type" in assets.columns else F.lit(None).cast("string")
    return assets.select(F.col("label").alias("asset_label"), F.col("id").alias("asset_id"), F.col("name").alias("asset_name"), kind.alias("asset_type")).orderBy(F.lower("asset_label"), "asset_label", "asset_id")
