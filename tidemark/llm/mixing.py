"""Mixing sources to target weights (operator 3, DataFrame functions only).

Words are summed per source, each source gets a target, the repetition rate is
target / size, and a document is emitted ``floor(rate)`` times plus once more
when a uniform draw hashed from seed, doc_id and text is below the fraction.
Rows equal in doc_id, source and text are numbered and the number is hashed too,
so each has a draw of its own and any number of them comes near its share.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and
share ``share`` times all words.  No target exceeds ``cap`` times its source's
words; what is above is shared again by weight among the others.  With sources
ordered by cap / weight the capped ones are a prefix of that order, so one pass
of running sums finds the final level that repeated resharing converges to.

Defined cases: null text has size 0; a null source is a source of its own; a
source without words has target 0 and its documents are not emitted; a null
doc_id draws as the text ``null``; which of rows equal in doc_id, source and text
has which number is not fixed, so if they differ in other columns reruns may
repeat another of them.  An empty table gives an empty mix.  Columns of any
other name pass through.

Numbers are given only to rows that are found to repeat, by hashes counted where
rows are read.  Their group may hold a third of all rows: it is dealt to
``SALTS`` parts, numbered in each, and the parts' counts are added up.

The table of sources is an aggregate.  It is broadcast only when it is checked
to be small; otherwise documents are salted, so that one source with a third
of all rows is spread over ``SALTS`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fits, saved, table, whole_row

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, "mix-1"
MAX_BROADCAST_SOURCES, SALTS = 20_000, 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(doc_id: Column, digest: Column, again: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1) from 52 bits of an MD5 of seed, doc_id, the text's digest and the number among equal rows."""
    parts = (F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), digest, again.cast("string"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def numbered(docs: DataFrame) -> DataFrame:
    """``doc`` (the row as a struct), the ``digest`` of its text and its number ``again`` among rows equal in doc_id, source and text, from 1."""
    rows = docs.select(whole_row(docs).alias("doc"), F.md5(F.coalesce(docs["text"], F.lit(""))).alias("digest"))
    own = [F.col("doc.doc_id").alias("of_id"), F.col("doc.source").alias("of_source"), F.col("digest").alias("of_digest")]
    repeated = saved(rows.groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated")
    if repeated.isEmpty():
        return rows.withColumn("again", F.lit(1).cast("long"))
    same = lambda other: F.col("doc.doc_id").eqNullSafe(other["of_id"]) & F.col("doc.source").eqNullSafe(other["of_source"]) & (F.col("digest") == other["of_digest"])
    listed = F.broadcast(repeated) if fits(repeated, MAX_BROADCAST_SOURCES) else repeated
    marked = rows.join(listed, same(listed), "left")
    alone = marked.where("of_digest IS NULL").select("doc", "digest", F.lit(1).cast("long").alias("again"))
    many = marked.where("of_digest IS NOT NULL").select("doc", "digest", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    many = saved(many, "many")  # its salts must not change between the two uses
    key = [F.col("doc.doc_id"), F.col("doc.source"), F.col("digest")]
    parts = many.groupBy(*own, F.col("salt").alias("of_salt")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("of_id", "of_source", "of_digest").orderBy("of_salt")) - F.col("n")
    parts = parts.withColumn("before", before)
    place = F.row_number().over(Window.partitionBy(*key, "salt").orderBy("salt"))
    many = many.withColumn("place", place).join(parts, same(parts) & (F.col("salt") == F.col("of_salt")))
    return alone.unionByName(many.select("doc", "digest", (F.col("before") + F.col("place")).alias("again")))


def source_targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target for each source: as many rows as there are sources."""
    per = docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    in_turn = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(in_turn)
    per = per.select(
        "source", "source_size", place.alias("place"),
        F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight"),
    )
    per = per.withColumn("ceiling", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("ceiling").cast("double") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("ceiling").over(before), zero)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)
    )
    per = per.withColumn("capped", F.col("ceiling").cast("double") / F.col("weight") <= level)
    free = lambda c: F.coalesce(F.sum(F.when(~F.col("capped"), F.col(c))).over(everything), zero)
    held = F.coalesce(F.sum(F.when(F.col("capped"), F.col("ceiling"))).over(everything), zero)
    rest = (F.sum("source_size").over(everything) * share - held) / F.nullif(free("weight"), zero)
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("ceiling").cast("double")).otherwise(rest * F.col("weight")).alias("target"))


def planned(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``doc`` (the row as a struct), size, source_size, target and copies of every document."""
    targets = saved(source_targets(docs, weights, share, cap), "targets").withColumnsRenamed({"source": "of_source"})
    rows = numbered(docs).withColumn("size", word_count(F.col("doc.text")))
    if fits(targets, MAX_BROADCAST_SOURCES):
        rows = rows.join(F.broadcast(targets), F.col("doc.source").eqNullSafe(F.col("of_source")))
    else:
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("of_salt", F.pmod(F.xxhash64("doc.doc_id"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, F.col("doc.source").eqNullSafe(F.col("of_source")) & (F.col("salt") == F.col("of_salt")))
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    extra = (draw(F.col("doc.doc_id"), F.col("digest"), F.col("again"), seed) < rate - F.floor(rate)).cast("long")
    return rows.select("doc", "size", "source_size", "target", (F.floor(rate) + extra).alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each row ``copies`` times."""
    rows = planned(docs, **settings).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planned(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS again,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS ceiling FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce((sum(ceiling) OVER w)::BIGINT, 0))
            / ((sum(weight) OVER ())::BIGINT - coalesce((sum(weight) OVER w)::BIGINT, 0))::DOUBLE AS level
  FROM weighed
  WINDOW w AS (ORDER BY ceiling::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, ceiling::DOUBLE / weight <= level AS capped FROM levels),
rest AS (
  SELECT (1.5::DOUBLE * sum(source_size)::BIGINT - coalesce(sum(ceiling) FILTER (capped), 0)::BIGINT)
         / nullif(coalesce(sum(weight) FILTER (NOT capped), 0)::BIGINT, 0)::DOUBLE AS level FROM capped),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN ceiling::DOUBLE ELSE rest.level * weight END AS target FROM capped, rest),
rated AS (
  SELECT doc_id, size, source_size, target, coalesce(target / nullif(source_size, 0), 0) AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || digest || ':' || again), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
