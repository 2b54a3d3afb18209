"""Benchmark decontamination by a prefix-filtered set join (operator 7).

A window is ``window`` consecutive words of a benchmark item (a shorter item is
one window).  It occurs in a document where its words stand in a row, that is
with containment 1.  For that containment one prefix token is necessary, so of
the word shingles of each window the one that is rarest over all documents is
its prefix; where a document holds that shingle the window can only start at
one place.  Bounds on length and position leave the places where it fits, and
there the words are compared exactly.

1. Distinct items are read in groups of about ``MAX_GROUP_BYTES`` of text.  A
   group's windows are what is broadcast, as arrays, one group at a time, so the
   size of what is held is bounded.
2. Every document is read once for the frequencies of the group's shingles,
   combined per task and summed by Spark.
3. Documents are joined with the prefixes and verified in one map, without a
   shuffle, so hot passages and keys are spread as the input is.
4. With more than one group each is a job of its own that writes what it finds in
   the texts that it hits; then the findings of a text are merged and joined to
   the documents by the text's digest.  More items mean more jobs, not a larger
   broadcast or a longer plan.

Words outside the benchmark are one code: they break every window.

Defined cases: null and empty texts have no words, hit nothing and are not
contaminated; repeated documents each get a row; repeated windows count once
for words and once per item; an item with null id counts as the item ``null``;
items without words match nothing; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, shared_dir, table, whole_row

WINDOW, SHINGLE, SHARE = 13, 5, 20
MAX_GROUP_BYTES = 2 << 20
#: Bytes of words kept: digits, letters and everything beyond ASCII; A-Z is lower-cased, the rest becomes a blank.
KEEP = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: The same words as a pattern.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
JUDGED = "n_words long, n_hit long, spans array<long>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(KEEP).split()


class Windows:
    """Distinct windows of a group of items, as rows of word codes, and their shingles; arrays only, so it is cheap to send."""

    def __init__(self, items: pa.Table, window: int, shingle: int):
        words = [words_of(t.as_py()) for t in items["text"]]
        coded = pa.chunked_array([pa.array(w, pa.binary()) for w in words], pa.binary()).combine_chunks().dictionary_encode()
        self.words, self.by_word = coded.dictionary, None
        self.items, item = np.unique(np.array(items["item"].to_pylist(), object), return_inverse=True)
        codes, n = coded.indices.to_numpy().astype(np.int32), np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(n) - n
        rows, holders, self.shingles, at = [], [], [], 0
        for length in np.unique(np.minimum(n[n > 0], window)).tolist():
            own = np.flatnonzero(n >= window) if length == window else np.flatnonzero(n == length)
            many = n[own] - length + 1
            owner = np.repeat(own, many)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + begin[owner]
            every = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, length)[start])
            distinct, which = np.unique(every.view(f"V{4 * length}").ravel(), return_inverse=True)
            distinct = distinct.view(np.int32).reshape(-1, length)
            rows.append(distinct)
            self.shingles.append(gram_keys(distinct.T, min(shingle, length)).T)
            holders.append(np.unique((at + which) * len(self.items) + item[owner]))
            at += len(distinct)
        held = np.concatenate([np.empty(0, np.int64), *holders])
        self.held_items = held % max(1, len(self.items))
        self.held_at = np.searchsorted(held // max(1, len(self.items)), np.arange(at + 1))
        self.length = np.concatenate([np.empty(0, np.int64), *(np.full(len(r), r.shape[1]) for r in rows)])
        self.flat = np.concatenate([np.empty(0, np.int32), *(r.ravel() for r in rows)])
        self.flat_at = np.concatenate([[0], np.cumsum(self.length)])
        self.keys = np.unique(np.concatenate([np.empty(0, np.uint64), *(k.ravel() for k in self.shingles)]))
        self.grams = sorted({min(shingle, r.shape[1]) for r in rows})

    def __getstate__(self) -> dict:
        return self.__dict__ | {"by_word": None}

    def code(self, words: list[bytes]) -> np.ndarray:
        if self.by_word is None:  # once in each Python worker
            self.by_word = {w: i for i, w in enumerate(self.words.to_pylist())}
        return np.fromiter(map(self.by_word.get, words, repeat(-1)), np.int64, len(words))

    def items_of(self, windows: np.ndarray) -> list[str]:
        own = [self.held_items[self.held_at[w] : self.held_at[w + 1]] for w in np.unique(windows)]
        return self.items[np.unique(np.concatenate(own))].tolist() if own else []

    def found(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document that hold a listed shingle, and which."""
        at, which = [], []
        for g in self.grams:
            known = ids >= 0
            ok = known[: len(ids) - g + 1].copy() if len(ids) >= g else known[:0]
            for j in range(1, g):
                ok &= known[j : j + len(ok)]
            if (p := np.flatnonzero(ok)).size:
                keys = gram_keys(ids, g)[p]
                k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                hit = self.keys[k] == keys
                at.append(p[hit])
                which.append(k[hit])
        return (np.concatenate(at), np.concatenate(which)) if at else (np.empty(0, np.int64), np.empty(0, np.int64))

    def take_prefixes(self, counts: np.ndarray) -> None:
        """The rarest shingle of each window, ties to the smaller key; then by shingle: windows and offsets."""
        rank = np.empty(len(self.keys), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(self.keys))  # keys are sorted already
        key, offset = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for each in self.shingles:
            k = np.searchsorted(self.keys, each)
            best = np.argmin(rank[k], axis=1)
            offset.append(best)
            key.append(k[np.arange(len(k)), best])
        key, offset = np.concatenate(key), np.concatenate(offset)
        self.window_of = np.argsort(key, kind="stable")
        self.offset_of = offset[self.window_of]
        self.first = np.searchsorted(key[self.window_of], np.arange(len(self.keys) + 1))
        self.shingles = []

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """start, window of every occurrence: prefix join, bounds, exact comparison."""
        at, k = self.found(ids)
        n = self.first[k + 1] - self.first[k]
        at, k, n = at[n > 0], k[n > 0], n[n > 0]
        if not n.size:
            return n, n
        entry = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        w = self.window_of[entry]
        start = np.repeat(at, n) - self.offset_of[entry]
        fits = (start >= 0) & (start + self.length[w] <= len(ids))
        start, w = start[fits], w[fits]
        same = np.ones(len(w), bool)
        for j in range(int(self.length[w].max(initial=0))):
            i = np.flatnonzero(same & (self.length[w] > j))
            same[i] = ids[start[i] + j] == self.flat[self.flat_at[w[i]] + j]
        return start[same], w[same]


def gram_keys(ids: np.ndarray, g: int) -> np.ndarray:
    """A 64-bit key for each run of g codes; equal runs have equal keys, others are told apart later."""
    x = ids.astype(np.uint64) + np.uint64(1)
    key = np.full((max(0, len(ids) - g + 1), *ids.shape[1:]), g, np.uint64)
    for j in range(g):
        key = (key ^ x[j : j + len(key)]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _groups(benchmark: DataFrame) -> tuple[int, Iterator[pa.Table]]:
    """The number of groups and each group in turn; one is held at a time."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // MAX_GROUP_BYTES
    part = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return n, (part.where(F.col("part") == i).select("item", "text").toArrow() for i in range(n))


def judge(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``, default all), n_words, n_hit, spans, items of each row of ``docs``.

    ``spans`` holds start and end of each maximal run of hit words, one after the other.
    """
    keep = keep or [*docs.columns]
    n_groups, groups = _groups(benchmark)
    if n_groups > 1:
        return _judged_by_groups(in_batches(docs), groups, keep, window, shingle)
    held = _prepared(in_batches(docs), next(groups), window, shingle)
    schema = T.StructType([T.StructField("doc", T.StructType([docs.schema[c] for c in keep]))] + T._parse_datatype_string(JUDGED).fields)
    return docs.select(whole_row(docs).alias("doc")).mapInArrow(_judge(held, keep), schema)


def _prepared(docs: DataFrame, items: pa.Table, window: int, shingle: int):
    """The windows of a group as a broadcast, with the prefixes that the documents' shingles make rarest."""
    context = docs.sparkSession.sparkContext
    listed = Windows(items, window, shingle)
    held = context.broadcast(listed)

    def count(batches):
        listed = held.value
        total = np.zeros(len(listed.keys), np.int64)
        for batch in batches:
            for text in batch.column(0):
                _, k = listed.found(listed.code(words_of(text.as_py())))
                total += np.bincount(k, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counts = np.zeros(len(listed.keys), np.int64)
    for r in docs.select("text").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["k"]] = r["n"]
    listed.take_prefixes(counts)
    held.unpersist()
    return context.broadcast(listed)


def _told(listed: Windows, text: str | None) -> tuple[int, int, list[int], list[str]]:
    """n_words, n_hit, spans, items of a text."""
    ids = listed.code(words_of(text))
    start, w = listed.occurrences(ids)
    return len(ids), *_covered(start, start + listed.length[w]), listed.items_of(w)


def _covered(start: np.ndarray, end: np.ndarray) -> tuple[int, list[int]]:
    """Words in any of the spans, and the maximal runs of them."""
    place, which = np.unique(np.concatenate([start, end]), return_inverse=True)
    edge = np.bincount(which[: len(start)], minlength=len(place)) - np.bincount(which[len(start) :], minlength=len(place))
    turns = place[np.flatnonzero(np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0))]
    return int((turns[1::2] - turns[::2]).sum()), turns.tolist()


TOLD = ["doc", "n_words", "n_hit", "spans", "items"]


def _judge(held, out: list[str]):
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()))

    def run(batches):
        listed = held.value
        for batch in batches:
            doc = batch.column(0)
            told = [_told(listed, t.as_py()) for t in doc.field("text")]
            cols = list(zip(*told, strict=True)) if told else [[]] * 4
            kept = pa.StructArray.from_arrays([doc.field(c) for c in out], names=out)
            yield pa.RecordBatch.from_arrays([kept, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], TOLD)

    return run


HITS = "digest string, spans array<long>, items array<string>"


def _judged_by_groups(docs: DataFrame, groups: Iterator[pa.Table], keep: list[str], window: int, shingle: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.where("text IS NOT NULL").select(F.md5("text").alias("digest"), "text")
    path = f"{shared_dir(spark)}/tidemark-hits-{uuid.uuid4().hex}"
    for items in groups:
        held = _prepared(docs, items, window, shingle)
        texts.mapInArrow(_hits(held), HITS).distinct().write.mode("append").parquet(path)
        held.destroy()

    def merged(batches):
        for batch in batches:
            spans = [np.array([x for group in own for x in group], np.int64) for own in batch.column(1).to_pylist()]
            cols = [_covered(s[::2], s[1::2]) for s in spans]
            items = [sorted({i for group in own for i in group}) for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in cols], pa.int64()), pa.array([s for _, s in cols], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["digest", *TOLD[2:]])

    # a text has a finding of each group at most
    found = spark.read.schema(HITS).parquet(path).groupBy("digest").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    found = found.mapInArrow(merged, "digest string, n_hit long, spans array<long>, items array<string>").withColumnRenamed("digest", "of_digest")
    rows = docs.select(whole_row(docs.select(*(f"`{c.replace('`', '``')}`" for c in keep))).alias("doc"), F.md5("text").alias("digest"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    none = F.array().cast("array<long>"), F.array().cast("array<string>")
    rows = rows.join(found, F.col("digest") == F.col("of_digest"), "left")
    return rows.select("doc", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))


def _hits(held):
    def run(batches):
        listed = held.value
        for batch in batches:
            told = [(d, *_told(listed, t.as_py())) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            told = [(d, spans, items) for d, _, n_hit, spans, items in told if n_hit]
            digests, spans, items = zip(*told, strict=True) if told else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["digest", "spans", "items"])

    return run


def contaminated(share: int = SHARE):
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    return judge(docs, benchmark, **settings).where(~contaminated()).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = judge(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return rows.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
  FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM doc, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT DISTINCT r, i, n, item FROM places JOIN windows USING (n, words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
