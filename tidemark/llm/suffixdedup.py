"""Removal of repeated byte strings with suffix arrays (operator 10).

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts
earlier: in a document of smaller doc_id, or earlier in its own.

Suffixes that can share ``LENGTH`` bytes are brought together by content.  Of
the hashes of all runs of ``GRAM`` bytes inside a window of ``LENGTH`` bytes the
least one (the leftmost of equals) is the window's anchor.  Equal windows have
equal anchors, and neighbouring windows mostly share one; windows in a row with
one anchor are a segment, some 30 windows.

1. Every document is cut into segments: rows of anchor hash and place.  Of
   segments of a batch with the same bytes only the first is sent on by its hash;
   the others are known to repeat and are spread evenly.
2. The rows of an anchor hash meet, sorted, and are streamed.  An anchor with one
   row repeats nothing; the rows of all others are kept for 3.
3. The bytes of those segments are fetched and meet by anchor hash.  Segments of
   the same bytes count once, all but the first repeat.  Different ones are sorted
   by two-stage suffix sorting (``suffixsort``) in blocks of bounded size, and
   adjacent common prefixes of ``LENGTH`` bytes show the windows that repeat.
   The segments of an anchor with more than ``HOT`` rows would not fit a block:
   their windows are dealt to parts by their bytes first, and each part is
   sorted in the same way.
4. The repeated windows of each document meet its text once more, which is
   moved compressed.

Hashes only bring together what may be equal; bytes and suffix order decide.

Defined cases: null text is empty; rows that repeat doc_id and text count as
one document and get the same result; rows of one doc_id with different texts
are ordered by the hash of the text; a null doc_id comes before all others;
texts under ``LENGTH`` bytes lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, saved, table
from .suffixsort import common_prefixes, suffix_order

LENGTH, GRAM = 100, 32
HOT, BLOCK_BYTES, PIECE, ROWS = 20_000, 4 << 20, 1 << 17, 10_000
NULL_ID = -(1 << 63)
PLACE = "kind int, route long, h long, doc long, v long, at long"

_BASE = 0x9E3779B97F4A7C15
_UP = np.cumprod(np.append(np.uint64(1), np.full(PIECE + LENGTH, _BASE, np.uint64)))
_DOWN = np.cumprod(np.append(np.uint64(1), np.full(PIECE + LENGTH, pow(_BASE, -1, 1 << 64), np.uint64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def segments(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each segment; long texts go in pieces."""
    found = [_piece(b[i : i + PIECE + LENGTH - 1], i) for i in range(0, max(0, len(b) - LENGTH + 1), PIECE)]
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (*[np.empty(0, np.int64)] * 2, np.empty(0, np.uint64))


def _piece(b: np.ndarray, base: int):
    n, wide = len(b), LENGTH - GRAM + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: n - GRAM + 1])
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lo = np.flatnonzero(np.diff(anchor, prepend=-1))
    count = np.diff(lo, append=len(anchor))
    return lo + base, count, gram[anchor[lo]]


def _named(docs: DataFrame) -> DataFrame:
    """doc (the id), v (0, or the text's hash where an id has several texts), key (of both) and text of every row."""
    rows = docs.select(docs["doc_id"], F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    x = F.xxhash64("text")
    many = saved(rows.groupBy("doc").agg(F.min(x).alias("a"), F.max(x).alias("b")).where("a <> b").select("doc", F.lit(True).alias("many")), "many")
    if many.isEmpty():
        rows = rows.withColumn("v", F.lit(0).cast("long"))
    else:
        rows = rows.join(many, "doc", "left").withColumn("v", F.when(F.col("many"), x).otherwise(F.lit(0).cast("long")))
    return rows.select("doc_id", "doc", "v", _key().alias("key"), "text")


def _places(batches):
    """Rows of PLACE; ``at`` holds first window and number of windows.  kind 0: a segment whose bytes came before in the batch."""
    for batch in batches:
        h, doc, v, at, texts = [], [], [], [], []
        for d, x, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            texts.append(text.encode())
            lo, n, anchor = segments(np.frombuffer(texts[-1], np.uint8))
            h.append(anchor)
            doc.append(np.full(len(lo), d))
            v.append(np.full(len(lo), x))
            at.append(lo << 8 | n)
        if not h:
            continue
        owner = np.repeat(np.arange(len(h)), list(map(len, h)))
        h, doc, v, at = (np.concatenate(x) for x in (h, doc, v, at))
        by = np.lexsort((at, v, doc, h))
        h, doc, v, at, owner = h[by], doc[by], v[by], at[by], owner[by]
        again, twice = np.zeros(len(h), bool), _same(h, doc, v, at)
        several = _same(h)
        several[:-1] |= several[1:]
        lo, n = _bounds(at)
        seen, last = set(), None
        for i in np.flatnonzero(several & ~twice).tolist():
            if h[i] != last:
                seen, last = set(), h[i]
            held = texts[owner[i]][lo[i] : lo[i] + n[i] + LENGTH - 1]
            again[i] = held in seen
            seen.add(held)
        route = np.where(again, _mixed(doc.astype(np.uint64) * np.uint64(_BASE) ^ at.astype(np.uint64)), h).view(np.int64)
        cols = [np.where(again, 0, 1).astype(np.int32), route, h.view(np.int64), doc, v, at]
        yield pa.RecordBatch.from_arrays([pa.array(x[~twice]) for x in cols], ["kind", "route", "h", "doc", "v", "at"])


def _same(*cols: np.ndarray) -> np.ndarray:
    """Whether a row equals the one before it."""
    out = np.zeros(len(cols[0]), bool)
    out[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in cols])
    return out


def _judged(batches):
    """kind 0 as it is; of kind 1 the rows of anchors that have several.  Sorted rows, constant memory."""
    last: list | None = None  # the last row: h, doc, v, at, whether it was given out
    for batch in batches:
        kind, h, doc, v, at = (batch.column(i).to_numpy() for i in (0, 2, 3, 4, 5))
        plain = kind == 0
        out = [(np.zeros(plain.sum(), np.int32), h[plain], doc[plain], v[plain], at[plain])]
        rows = [x[~plain] for x in (h, doc, v, at)]
        if len(rows[0]):
            given = np.zeros(len(rows[0]) + (last is not None), bool)
            if last:
                rows = [np.append(x, y) for x, y in zip(last[:4], rows, strict=True)]
                given[0] = last[4]
            new = ~_same(*rows)  # a row that was read twice counts once
            rows, given = [x[new] for x in rows], given[new]
            alike = _same(rows[0])
            several = alike.copy()
            several[:-1] |= alike[1:]
            several[0] |= given[0]
            e = several & ~given
            out.append((np.ones(e.sum(), np.int32), *(x[e] for x in rows)))
            last = [*(x[-1] for x in rows), bool(several[-1])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["kind", "h", "doc", "v", "at"])


def _bounds(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return at >> 8, at & 255


def _packed_texts(batches):
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        *names, text = batch.columns
        yield pa.RecordBatch.from_arrays([*names, pa.array([squeeze(t.encode()) for t in text.to_pylist()], pa.binary())], [*batch.schema.names[:-1], "z"])


FETCHED = pa.schema([("h", pa.int64()), ("part", pa.int32()), ("doc", pa.int64()), ("v", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])


def _fetched(parts: int = 0):
    """The bytes of the segments listed for each document; with ``parts`` those of each window apart, dealt by their hash."""

    def run(batches):
        for batch in batches:
            for doc, v, z, hs, ats in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                text = zstandard.decompress(z)
                h, at = np.array(hs, np.int64), np.array(ats, np.int64)
                if parts:
                    lo, n = _bounds(at)
                    into = np.cumsum(n) - n
                    at = (np.repeat(lo - into, n) + np.arange(n.sum())) << 8 | 1
                    h = np.repeat(h, n)
                for i in range(0, len(at), ROWS):
                    held = [text[a : a + n + LENGTH - 1] for a, n in zip(*map(np.ndarray.tolist, _bounds(at[i : i + ROWS])), strict=True)]
                    part = [xxhash.xxh3_64_intdigest(x) % parts if parts else 0 for x in held]
                    k = len(held)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((h[i : i + ROWS], part, np.full(k, doc), np.full(k, v), at[i : i + ROWS], held), FETCHED.types, strict=True)], schema=FETCHED)

    return run


def repeated_windows(doc: np.ndarray, v: np.ndarray, at: np.ndarray, held: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, v, at of runs of windows that an earlier window of the block equals."""
    text = np.frombuffer(b"".join(held), np.uint8)
    size = np.array([len(x) for x in held], np.int64)
    base = np.cumsum(size) - size
    lo, n = _bounds(at)
    owner = np.repeat(np.arange(len(held)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    where = base[owner] + offset
    wanted = np.zeros(len(text), bool)
    wanted[where] = True
    window = np.zeros(len(text), np.int64)
    window[where] = np.arange(len(where))
    order = suffix_order(text, wanted, LENGTH)
    run = np.cumsum(common_prefixes(text, order, LENGTH) < LENGTH)
    w = window[order]
    o = owner[w]
    by = np.lexsort((lo[o] + offset[w], v[o], doc[o], run))  # in a run the earliest first
    w, run = w[by], run[by]
    o = owner[w]
    # a row that was read twice is no repeat of itself: only other places than a run's first count
    head = np.repeat(np.flatnonzero(~_same(run)), np.unique(run, return_counts=True)[1])
    dup = np.sort(w[(doc[o] != doc[o[head]]) | (v[o] != v[o[head]]) | (lo[o] + offset[w] != lo[o[head]] + offset[w[head]])])
    if not dup.size:
        return dup, dup, dup
    start = np.flatnonzero(np.append(True, (np.diff(dup) != 1) | (np.diff(owner[dup]) != 0)))
    first, count = dup[start], np.diff(np.append(start, len(dup)))
    o = owner[first]
    return doc[o], v[o], (lo[o] + offset[first]) << 8 | count


REPEATED = pa.schema([("doc", pa.int64()), ("v", pa.int64()), ("at", pa.int64())])


def _sorted_blocks(batches):
    """Whole anchors (or parts of one) in blocks of about BLOCK_BYTES; rows come sorted, HOT bounds the different ones of an anchor."""

    def give():
        found = repeated_windows(*(np.array([r[i] for r in block], np.int64) for i in range(3)), [r[3] for r in block])
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=REPEATED)

    block, size, of, seen = [], 0, None, {}
    for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        repeats = []
        for h, part, doc, v, at, held in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if of != (h, part):
                of, seen = (h, part), {}
                if size >= BLOCK_BYTES:
                    yield give()
                    block, size = [], 0
            place = (doc, v, at)
            if (first := seen.setdefault(held, place)) is place:
                block.append((*place, held))
                size += len(held)
            elif first != place:  # a row that was read twice is no repeat of itself
                repeats.append(place)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*repeats, strict=True)] if repeats else [pa.array([], pa.int64())] * 3, schema=REPEATED)
    if block:
        yield give()


def _key():
    return F.concat_ws(":", "doc", "v")


def _cleaned(with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, z, ats in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = np.frombuffer(zstandard.decompress(z), np.uint8)
                lo, n = _bounds(np.array(ats or [], np.int64))
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, lo, 1)
                np.add.at(edge, lo + n + LENGTH - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = text[~gone].tobytes()
                spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                rows.append((doc_id, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            yield pa.RecordBatch.from_pydict(dict(zip(CLEANED.names, zip(*rows, strict=True) if rows else [()] * 6, strict=True)), CLEANED)

    return run


CLEANED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def repeats(named: DataFrame, texts: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, v, at of runs of windows that also start earlier; ``texts`` has the packed text of each key."""
    places = named.select("doc", "v", "text").mapInArrow(_places, PLACE)
    places = places.repartition("route").sortWithinPartitions("kind", "h", "doc", "v", "at")
    judged = saved(places.mapInArrow(_judged, "kind int, h long, doc long, v long, at long"), "judged")
    several = judged.where("kind = 1")

    def sorted_(rows: DataFrame, parts: int = 0) -> DataFrame:
        wanted = rows.groupBy(_key().alias("key"), "v").agg(F.collect_list(F.struct("h", "at")).alias("s"))
        # all columns of ``texts`` are used, as in remove_repeats, so that Spark shuffles it once for both
        held = texts.join(wanted, "key").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "v", "z", F.col("s.h").alias("hs"), F.col("s.at").alias("ats"))
        held = held.mapInArrow(_fetched(parts), "h long, part int, doc long, v long, at long, bytes binary")
        held = held.repartition("h", "part").sortWithinPartitions("h", "part", "doc", "v", "at")
        return held.mapInArrow(_sorted_blocks, "doc long, v long, at long")

    crowded = saved(several.groupBy("h").count().where(F.col("count") > hot), "hot")
    found = judged.where("kind = 0").select("doc", "v", "at")
    if (most := crowded.agg(F.max("count")).first()[0]) is None:
        return found.unionByName(sorted_(several))
    # a segment has LENGTH windows at most; parts of an anchor then have about ``hot`` of them
    parts = -(-most * LENGTH // hot)
    hot_rows, others = several.join(crowded, "h", "left_semi"), several.join(crowded, "h", "left_anti")
    return found.unionByName(sorted_(others)).unionByName(sorted_(hot_rows, parts))


def remove_repeats(docs: DataFrame, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept of each row."""
    named = _named(in_batches(docs))
    texts = named.select("doc_id", "key", "text").mapInArrow(_packed_texts, "doc_id long, key string NOT NULL, z binary")
    gone = repeats(named, texts, hot).groupBy(_key().alias("key")).agg(F.collect_list("at").alias("ats"))
    rows = texts.join(gone, "key", "left").select("doc_id", "z", "ats")
    return rows.mapInArrow(_cleaned(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False).drop("kept")


SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM docs, unnest(range(0, length(h) // 2 - 99)) AS t(i)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
begins AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS b FROM again),
numbered AS (SELECT doc_id, i, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM begins),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, lo, hi, substr(h, 2 * coalesce(lag(hi) OVER w, 0) + 1, 2 * (lo - coalesce(lag(hi) OVER w, 0))) AS kept
  FROM spans JOIN docs USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY lo)),
cut AS (SELECT doc_id, sum(hi - lo) AS gone, count(*) AS n, max(hi) AS hi, string_agg(kept, '' ORDER BY lo) AS kept FROM pieces GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(hi, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""
