"""SimHash near-duplicates (operator 9).

A fingerprint bit is the majority of that bit over the XXH64 hashes of all
word shingles.

*Within a number of bits* (``near_duplicates``): fingerprints are cut into
``blocks`` blocks; two that differ in at most ``distance`` bits agree on some
``blocks - distance`` of them, so they meet in a join on one such combination,
and the Hamming distance is verified inside the join.  With 8 blocks of 8 bits a
combination fixes 48 bits: a bucket holds at most 2^16 different fingerprints,
however many documents there are.  Only distinct fingerprints are joined, so
exact copies and all documents of one fingerprint cost one row; no pair is
formed between them.  Components of the links are found in Spark
(``components``) and joined back by fingerprint.

*Within a Jaccard similarity* (``one_of_each``, for the pipeline): at 0.8 two
texts differ in some 10 of 64 bits, which no blocks of one fingerprint tell from
chance.  So the shingles are dealt into blocks by their hashes first, and every
block has a fingerprint of its own.

1. The few shingles that two near copies do not share lie in few blocks, so by
   the pigeonhole principle they share others whole.  There are more blocks for
   longer texts (``block_level``), short ones are dealt several times, and the
   first ``BLOCK_KEYS`` blocks are joined; texts near a change of their number
   are joined under both numbers.  Of pairs at 0.8 some 99.9 % share a key at
   worst, of closer ones more.
2. In the join fingerprints of the whole texts, of ``WIDE`` words of 64 bits, are
   compared (``far``: three standard deviations above what 0.8 gives).
3. What is left is compared by whole shingle sets.  First each text of a key
   with one leader, the one that meets most texts in all its keys and so is
   likely what others were copied from, which is linear and joins large groups;
   then those of a key that are still in different groups with each other, each
   pair at the first of its keys.  No key is capped and no pair is left out.

Defined cases: null and empty texts have fingerprint 0 and link like any other,
and are copies of each other; fewer words than a shingle give one shingle of
them all; a null doc_id never becomes a component id unless nothing else can
(then it is null); rows that repeat a doc_id each get a row.  Of a group
``one_of_each`` keeps the row of the smallest doc_id, null last, then of the
smallest MD5 of the text, then of the smallest hash of the row, so doc_id does
not identify a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, saved, table, whole_row
from .components import connected_components

SHINGLE, DISTANCE, BLOCKS, SEED = 3, 2, 8, 42
#: Hashes whose bits are counted at once: bounds memory for very long texts.
STEP = 1 << 16
#: Of near copies: words to a shingle, least Jaccard similarity, blocks joined, words of 64 bits.
COPY_SHINGLE, SIMILARITY, BLOCK_KEYS, WIDE = 5, 0.8, 24, 16
#: Rounds of leaders.
LEADERS = 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in turn; ``bytes.lower`` and ``bytes.split`` treat exactly A-Z and the characters \\x20 \\x09-\\x0D."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1).tolist()
    ends, width, digest = ends.tolist(), min(shingle, len(words)), xxhash.xxh64_intdigest
    for i in range(0, len(words) - width + 1, STEP):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + STEP], ends[i + width - 1 : i + width - 1 + STEP])], "<u8")


def bit_counts(h: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """How many of the hashes of each group have each of the 64 bits; groups of 255 at most, or all as one group."""
    lanes = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view("<u8")  # 8 bits counted in one addition
    if starts is None:
        return np.add.reduceat(lanes, np.arange(0, len(h), 255)).view(np.uint8).sum(axis=0, dtype=np.int64)
    return np.add.reduceat(lanes, starts).view(np.uint8).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        counts += bit_counts(h)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return in_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """a, b: distinct fingerprints that differ in at most ``distance`` bits; ``fps`` has each fp once."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    kept = [sum(c) for c in combinations(masks, blocks - distance)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    key = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("k")) for i, m in enumerate(kept)))
    keys = fps.select("fp", F.explode(key).alias("key")).select("fp", "key.t", "key.k")
    a, b = keys.alias("a"), keys.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k"))
    # a merge join, as Spark takes the exploded keys for no larger than the file of fingerprints and would broadcast them
    return a.hint("merge").join(b.hint("merge"), same & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    fps = saved(fingerprints(docs, shingle), "fps")
    least = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "least")
    roots = saved(connected_components(links(least, distance, blocks)), "roots")
    ids = roots.join(least, roots["node"] == least["fp"]).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(ids, "root").select(F.col("node").alias("fp"), "component_id")
    # written first, so that the join with all rows has plain inputs and Spark may split a hot fingerprint
    per = saved(least.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return fps.join(per, "fp").select("doc_id", "fp", "component_id")


# --- near copies ---


def distinct_shingles(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, shingle)]))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE words of 64 bits, as longs."""
    counts = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(hashes), STEP):
        h = hashes[i : i + STEP]
        for j in range(WIDE):
            more = (h ^ np.uint64((int(_ODD) * (2 * j + 1)) % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
            more = (more ^ more >> np.uint64(32)) * _ODD
            counts[64 * j : 64 * j + 64] += bit_counts(more ^ more >> np.uint64(29))
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")


def far(n: int) -> int:
    """Bits in which fingerprints of two near copies may differ; majorities of few shingles change more easily."""
    return 64 * WIDE // 4 if n < 12 else 215 * WIDE // 16 if n < 64 else 192 * WIDE // 16


def block_level(n: float) -> int:
    """A text of n shingles has 2 to this number of blocks in a dealing: of 3 to 6 shingles on average, two blocks at least."""
    return max(1, int(n / 3).bit_length() - 1)


def block_keys(hashes: np.ndarray, keys: int = BLOCK_KEYS) -> np.ndarray:
    """Of sorted distinct hashes: the fingerprints of their first blocks, mixed with the block's number.

    Few blocks are dealt several times, each time by other bits, so that every text has about ``keys`` blocks.
    """
    n, found = len(hashes), []
    # a copy has n * 0.8 to n / 0.8 shingles; two such texts have one of these numbers of blocks in common
    for level in sorted({block_level(n), block_level(n / SIMILARITY)}):
        shift, deals = np.uint64(64 - level), -(-keys // (1 << level))
        if deals == 1:
            h = hashes[: np.searchsorted(hashes, np.uint64(keys) << shift)] if keys < 1 << level else hashes
            block = h >> shift
        else:
            number = np.arange(deals, dtype=np.uint64)[:, None]
            block = (hashes * (_ODD * (number * np.uint64(2) + np.uint64(1))) >> shift | number << np.uint64(level)).ravel()
            order = np.argsort(block, kind="stable")
            h, block = np.tile(hashes, deals)[order], block[order]
        if not len(h):
            continue
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        size = np.diff(np.append(starts, len(h)))
        # blocks of one shingle say little of texts that have more; blocks of over 255 would be those of thousands, by chance
        some = (size <= 255) & (size > (n >= 12))
        ones = bit_counts(h, starts)[some].reshape(-1, 64)
        fp = np.packbits(2 * ones > size[some, None], axis=1, bitorder="little").view("<u8").ravel()
        key = (fp ^ (block[starts][some] + np.uint64(level << 32)) * _ODD) * np.uint64(0xD6E8FEB86659FD93)
        found.append(key ^ key >> np.uint64(31))
    return np.concatenate(found).view(np.int64) if n else np.zeros(1, np.int64)


def _keyed(batches):
    for batch in batches:
        keys = [block_keys(distinct_shingles(t.as_py())) for t in batch.column(1)]
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *keys])))], ["node", "keys"])


BITS = [f"f{i}" for i in range(WIDE)]
SETS = "node binary, held binary, far int, " + ", ".join(f"{c} long" for c in BITS)


def _sets(batches):
    for batch in batches:
        hashes = [distinct_shingles(t.as_py()) for t in batch.column(1)]
        wide = np.array([wide_fingerprint(h) for h in hashes], np.int64).reshape(-1, WIDE)
        cols = [batch.column(0), pa.array([h.tobytes() for h in hashes], pa.binary()), pa.array([far(len(h)) for h in hashes], pa.int32()), *(pa.array(np.ascontiguousarray(x)) for x in wide.T)]
        yield pa.RecordBatch.from_arrays(cols, ["node", "held", "far", *BITS])


def similar(a: bytes, b: bytes, similarity: float = SIMILARITY) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b that are near copies."""

    def run(batches):
        for batch in batches:
            ok = pa.array([similar(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    side = lambda c: sets.select(F.col("node").alias(c), F.col("held").alias(f"held_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "held_a", "held_b")
    return in_batches(rows).mapInArrow(run, "a binary, b binary")


def _picked(named: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``named`` for each node, row of ``rows``."""
    return named.join(rows.select("node", "row"), ["node", "row"], "left_semi").dropDuplicates(["node", "row"])


def _close(x: str, y: str):
    bits = (F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in BITS)
    return reduce(add, bits) <= F.greatest(f"{x}far", f"{y}far")


def _copy_roots(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root of the texts that have a near copy."""
    text = _picked(named, nodes.select("node", "best.row")).select("node", "doc.text")
    keyed = saved(in_batches(text).mapInArrow(_keyed, "node binary, keys array<long>"), "keyed")
    keys = keyed.select(F.explode("keys").alias("key"), "node")
    members = keys.join(keys.groupBy("key").count().where("count > 1"), "key")
    met = F.sum("count").over(Window.partitionBy("node"))  # texts met in all keys: most for the text that others are copies of
    before = F.collect_list("key").over(Window.partitionBy("node").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    members = saved(members.select("key", "node", met.alias("met"), before.alias("before")), "members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "best.row")
    sets = saved(in_batches(_picked(named, wanted).select("node", "doc.text")).mapInArrow(_sets, SETS), "sets")
    left, roots = members.withColumn("root", F.col("node")), None
    for k in range(LEADERS + 1):
        open_ = left.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
        left = saved(left.join(open_.select("key"), "key"), "left")
        if left.isEmpty():
            break
        wide = left.join(sets.drop("held"), "node")
        last = k == LEADERS
        if last:
            other = wide.select("key", *(F.col(c).alias(f"other_{c}") for c in wide.columns if c != "key"))
            apart = (F.col("node") < F.col("other_node")) & (F.col("root") != F.col("other_root"))
            once = ~F.arrays_overlap("before", "other_before")  # at the first of the keys that two texts share
            found = wide.join(other, "key").where(apart & _close("", "other_") & once).select(F.col("node").alias("a"), F.col("other_node").alias("b"))
        else:
            of = F.struct(*(F.col(c).alias(f"lead_{c}") for c in ("node", "root", "far", *BITS)))
            lead = wide.groupBy("key").agg(F.min_by(of, F.struct(-F.col("met"), "node")).alias("l")).select("key", "l.*")
            found = wide.join(lead, "key").where((F.col("root") != F.col("lead_root")) & _close("", "lead_")).select(F.least("node", "lead_node").alias("a"), F.greatest("node", "lead_node").alias("b"))
        links = saved(_compared(saved(found.distinct(), "pairs"), sets), "links")
        known = links if roots is None else links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = saved(connected_components(known), "roots")
        if last:
            break
        left = left.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return named.sparkSession.createDataFrame([], "node binary, root binary") if roots is None else roots


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies."""
    text = F.coalesce(docs["text"], F.lit(""))
    named = docs.select(whole_row(docs).alias("doc"), F.unhex(F.md5(text.cast("binary"))).alias("node"))
    named = named.select("*", F.xxhash64("doc").alias("row"))
    best = F.min(F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), "row"))
    nodes = saved(named.groupBy("node").agg(best.alias("best")), "nodes")
    grouped = nodes.join(_copy_roots(named, nodes), "node", "left")
    kept = grouped.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("best.none", "best.id", "node", "best.row")).alias("kept"))
    return _picked(named, saved(kept.select("kept.*"), "kept")).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
