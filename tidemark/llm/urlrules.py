"""URL filter by host and path rules (operator 4).

A blocked Bloom filter holds the listed canonical urls (``host/path`` of each
rule).  A page's candidates are its host's suffixes joined to its path's
prefixes, of the lengths that occur in the list.  All bits of a key lie in one
block, so the filter is a table of blocks, and a candidate is looked up by a
hash join with its block and a test of bits.  Candidates that the filter lets
through are possible hits; an exact hash join with the list removes the false
positives.  The longest rule left decides; a url without one gets ``default``.

Candidates are made and tested where the pages are read, by expressions, without
a shuffle; only the hits of a url are brought together, combined per task first,
so a url or host that a third of all pages share costs a row of each task.  The
join back to the pages has unique urls on its other side and Spark may split a
hot one.

The filter is broadcast; its size is set by ``max_filter_bytes``.  A list too
long for it at ``bits_per_rule`` gets a fuller filter, which only means more
rows for the exact join.  The list itself is broadcast only when it is checked
to have at most ``MAX_BROADCAST_RULES`` rows.

Defined cases: null urls and urls without ``://`` have empty host and path and
match nothing; a rule whose path starts with ``/`` does not fit an empty path;
rules with null host or path are ignored, of repeated rules the smallest
verdict counts; an empty list leaves every url with ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fits, table, whole_row

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCK_BITS, HASHES = 512, 6
MAX_BROADCAST_RULES = 500_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _place(key: Column, n_blocks: int) -> Column:
    """Block of a key and its bits there, 9 bits of its hash each."""
    h = F.xxhash64(key)
    bits = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(BLOCK_BITS - 1).cast("int") for i in range(HASHES)]
    return F.struct(F.pmod(F.xxhash64(h), F.lit(n_blocks)).alias("block"), F.array(*bits).alias("bits"))


def bloom_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """block, words: the BLOCK_BITS bits of each block that is not empty, as an array of longs, from the column ``key``."""
    bits = keys.select(_place(F.col("key"), n_blocks).alias("at")).select("at.block", F.explode("at.bits").alias("bit"))
    value = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit") % 64)
    words = bits.groupBy("block", (F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(value).alias("value"))
    held = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias("by"))  # 8 words at most
    return held.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda i: F.coalesce(F.try_element_at("by", i), F.lit(0).cast("long"))).alias("words"))


def let_through(candidates: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of ``candidates`` whose ``key`` may be listed."""
    rows = candidates.select("*", _place(F.col("key"), n_blocks).alias("at")).select(*candidates.columns, F.col("at.block").alias("block"), F.col("at.bits").alias("bits"))
    is_set = lambda b: F.call_function("shiftright", F.get("words", (b / 64).cast("int")), b % 64).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.join(F.broadcast(bloom), "block").where(F.forall("bits", is_set)).select(*candidates.columns)  # max_filter_bytes bounds it


def candidate_keys(host: Column, path: Column, host_lengths: list[int], path_lengths: list[int]) -> Column:
    """The host's suffixes that begin a label, each joined to the path's prefixes."""
    array = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    n = F.char_length(host)
    whole_labels = lambda k: (k == n) | ((k < n) & (F.substr(host, n - k, F.lit(1)) == "."))
    hosts = F.transform(F.filter(array(host_lengths), whole_labels), lambda k: F.substr(host, n - k + 1, k))
    paths = F.transform(F.filter(array(path_lengths), lambda k: k <= F.char_length(path)), lambda k: F.left(path, k))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_filter_bytes: int = 16 << 20, bits_per_rule: int = 16) -> DataFrame:
    """``page`` (the row as a struct) and ``judged``: its host, path, rule and verdict."""
    listed = rules.where("host IS NOT NULL AND path IS NOT NULL").select("host", "path", F.concat("host", "path").alias("key"), "verdict")
    # lengths of hosts and paths: no more than the longest url has characters
    known = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("host")).alias("h"), F.collect_set(F.length("path")).alias("p")).first()
    n_blocks = max(1, min(max_filter_bytes * 8, known["n"] * bits_per_rule) // BLOCK_BITS)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    candidates = parts.select("url", F.explode(candidate_keys(F.col("host"), F.col("path"), sorted(known["h"]), sorted(known["p"]))).alias("key"))
    hits = let_through(candidates, bloom_filter(listed, n_blocks), n_blocks)
    exact = listed.groupBy("key").agg(F.min("verdict").alias("verdict"))
    hits = hits.join(F.broadcast(exact) if fits(exact, MAX_BROADCAST_RULES) else exact, "key")
    best = hits.groupBy("url").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key"), F.col("verdict"))).alias("best"))
    rows = pages.select(whole_row(pages).alias("page"), pages["url"].alias("page_url"))
    rows = rows.join(best, F.col("page_url") == F.col("url"), "left")
    host, path = host_and_path(F.col("page_url"))
    judged = F.struct(host.alias("host"), path.alias("path"), F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return rows.select("page", judged.alias("judged"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page.page_id", "judged.*")


SQL = r"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
  coalesce(arg_max(verdict, length(rhost || rpath)), 'allow') AS verdict
FROM (SELECT row_number() OVER () AS n, * FROM split) LEFT JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY n, page_id, host, path
"""
