"""Periodic run detection (operator 13).

A run is a stretch of consecutive words with smallest period q, as long as two
periods and ``least`` words at least, that cannot be longer with that period.
Texts are given back without the repetitions of their runs (``collapsed``).

Method, over the word codes of a whole batch of documents as arrays:

1. Grid.  A run of period p holds two neighbours jp and (j+1)p of the grid of p
   whose words are equal.  For all p of a document these are n log n pairs.
   Periods are taken by octaves, so the pairs held at once grow with n only.
2. Within runs that are found already, grid pairs of a multiple of the run's
   period are passed over: what they could give is that run again.
3. Pairs that are left are extended to both sides by comparing words p apart in
   chunks.  Of neighbouring pairs of one p that stay in one stretch the first is
   extended; the others are passed over with what it covers.
4. Of equal stretches the one of the smallest period is the run.

Everything is exact, no length or period is bounded.  Documents stay where they
are read: no shuffle, so hot keys are spread as the input is.

Defined cases: null and empty texts have no words, no run and collapse to an
empty text; repeated rows are searched each for itself; a word that differs in
case is another word; long texts are searched whole in one task, in time
n log n but for texts made to be alike everywhere; an empty table stays one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, table, whole_row

LEAST = 12
#: Words compared at first and at most in a step of an extension; cells of a comparison held at once.
NEAR, FAR, CELLS = 8, 4096, 1 << 21
#: A run of so many periods can hold runs of multiples, so it is worth looking for pairs within it.
LONG = 4


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts c: each index c times, and 0 to c - 1 for each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def matched(w: np.ndarray, at: np.ndarray, p: np.ndarray, room: np.ndarray, step: int, most: int | None = None) -> np.ndarray:
    """How many words from each ``at`` on (step 1) or before it (step -1) equal the word p later, of ``room`` and ``most``."""
    got = np.zeros(len(at), np.int64)
    room = np.maximum(room, 0) if most is None else np.clip(room, 0, most)
    live, chunk = np.flatnonzero(room > 0), NEAR
    while live.size:
        on = []
        for part in np.array_split(live, 1 + len(live) * chunk // CELLS):
            far = got[part][:, None] + np.arange(chunk)
            inside = far < room[part][:, None]
            i = np.where(inside, at[part][:, None] + (far if step > 0 else -1 - far), at[part][:, None])
            same = inside & (w[i] == w[i + p[part][:, None]])
            whole = same.all(axis=1)
            got[part] += np.where(whole, chunk, same.argmin(axis=1))
            on.append(part[whole & (got[part] < room[part])])
        live, chunk = np.concatenate(on), min(2 * chunk, FAR)
    return got


def _outside(doc: np.ndarray, p: np.ndarray, at: np.ndarray, long_runs: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Which grid pairs are not inside a run of a divisor of p; ``doc`` is sorted."""
    keep = np.ones(len(at), bool)
    for d, start, end, q in long_runs:
        i = slice(np.searchsorted(doc, d), np.searchsorted(doc, d, "right"))
        keep[i] &= ~((at[i] >= start) & (at[i] + p[i] < end) & (p[i] % q == 0))
    return keep


def _stretches(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """index of the pair, start and end of stretches of period p around grid pairs of documents from lo to hi; sorted by document, p and place."""
    needed = np.maximum(p, least - p)  # words that equal the one p later
    right = matched(w, at, p, hi - p - at, 1, NEAR)
    left = matched(w, at, p, at - lo, -1, NEAR)
    opened = (right == NEAR) & (at + NEAR < hi - p) | (left == NEAR) & (at - NEAR > lo)
    closed = np.flatnonzero(~opened & (left + right >= needed))
    found = [(closed, at[closed] - left[closed], at[closed] + right[closed])]
    todo = np.flatnonzero(opened)
    while todo.size:
        joined = np.zeros(len(todo), bool)  # to the pair before, of one document and p
        joined[1:] = (at[todo[1:]] == at[todo[:-1]] + p[todo[1:]]) & (p[todo[1:]] == p[todo[:-1]]) & (lo[todo[1:]] == lo[todo[:-1]])
        head = todo[~joined]
        a = at[head] - matched(w, at[head], p[head], at[head] - lo[head], -1)
        b = at[head] + matched(w, at[head], p[head], hi[head] - p[head] - at[head], 1)
        enough = b - a >= needed[head]
        found.append((head[enough], a[enough], b[enough]))
        # what lies beyond the stretch of the first of its chain is tried again
        covered = b[np.cumsum(~joined) - 1]
        todo = todo[joined & (at[todo] >= covered)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def find_runs(w: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, length, period of all runs, sorted; document d has the word codes ``w[first[d]:first[d + 1]]``."""
    n = np.diff(first)
    rows, long_runs, octave = [np.empty((0, 4), np.int64)], [], 1
    while (docs := np.flatnonzero(n >= max(least, 2 * octave))).size:
        k, step = _spread(np.minimum(octave, n[docs] // 2 - octave + 1))
        doc, p = docs[k], octave + step
        k, j = _spread((n[doc] - 1) // p)
        doc, p = doc[k], p[k]
        at = first[doc] + j * p
        equal = w[at] == w[at + p]
        doc, p, at = doc[equal], p[equal], at[equal]
        if long_runs:
            keep = _outside(doc, p, at, long_runs)
            doc, p, at = doc[keep], p[keep], at[keep]
        i, a, b = _stretches(w, first[doc], first[doc + 1], p, at, least)
        new = np.unique(np.column_stack([doc[i], a, b + p[i], p[i]]), axis=0)
        rows.append(new)
        long_runs += map(tuple, new[new[:, 2] - new[:, 1] >= LONG * new[:, 3]].tolist())
        octave *= 2
    doc, start, end, p = np.concatenate(rows).T
    order = np.lexsort((p, end, start, doc))
    doc, start, end, p = (x[order] for x in (doc, start, end, p))
    again = np.zeros(len(doc), bool)
    again[1:] = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & (end[1:] == end[:-1])
    doc, start, end, p = (x[~again] for x in (doc, start, end, p))
    order = np.lexsort((p, start, doc))
    return doc[order], (start - first[doc])[order], (end - start)[order], p[order]


TOLD = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Edit = Callable[[str | None, list[bytes]], list[bytes]]


def searched(docs: DataFrame, keep: list[str] | None = None, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``, default all), n_words, runs and collapsed of each row of ``docs``.

    ``runs`` are sorted by start and period.  ``collapsed`` is the text without what any run repeats, words joined by a
    blank.  ``edit`` makes other words of doc_id (as text) and words first.
    """
    keep = keep or docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(t or "").encode().split() for t in batch.column(2).to_pylist()]
            if edit:
                words = [edit(i, w) for i, w in zip(batch.column(1).to_pylist(), words, strict=True)]
            first = np.cumsum([0, *map(len, words)])
            coded = pa.chunked_array([pa.array(w, pa.binary()) for w in words], pa.binary()).combine_chunks().dictionary_encode()
            doc, start, length, period = find_runs(coded.indices.to_numpy(), first, least)
            edge = np.zeros(first[-1] + 1, np.int64)  # words dropped, by where that begins and ends
            np.add.at(edge, first[doc] + start + period, 1)
            np.add.at(edge, first[doc] + start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            texts = []
            for d, own in enumerate(words):
                stay = kept[first[d] : first[d + 1]]
                texts.append(b" ".join(own if stay.all() else [own[i] for i in np.flatnonzero(stay).tolist()]))
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN))
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(words) + 1)), pa.int32()), runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first), pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())], ["doc", "n_words", "runs", "collapsed"])

    kept = T.StructField("doc", T.StructType([docs.schema[c] for c in keep]))
    rows = in_batches(docs).select(whole_row(docs.select(*(f"`{c.replace('`', '``')}`" for c in keep))).alias("doc"), docs["doc_id"].cast("string"), "text")
    return rows.mapInArrow(run, T.StructType([kept, *T._parse_datatype_string(TOLD).fields]))


def planted(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The words of the registered query: one document in ten repeats a few words from a place on; a null doc_id hashes as the text ``null``."""
    h = zlib.crc32((doc_id or "null").encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return (words[:a] + words[a : a + p] * (1 + (n - a) // p))[:n]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = searched(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], edit=planted)
    # the longest, of these the first, of these that of the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = rows.select("doc.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


# A run has at least six words in a row that equal the word a period later, so six words are what is joined.
SQL = r"""
WITH crc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(coalesce(doc_id::VARCHAR, 'null'), '')]),
           lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
  FROM documents),
drawn AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS changed, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS k FROM crc),
sized AS (SELECT *, 1 + (n - a) // k AS p FROM drawn),
docs AS (SELECT r, doc_id, n, CASE WHEN changed THEN [w[1 + (CASE WHEN i >= a THEN a + (i - a) % p ELSE i END)::INT] FOR i IN range(n)] ELSE w END AS w FROM sized),
grams AS (SELECT r, i, hash(w[i + 1:i + 6]) AS g, w[i + 1:i + 6] AS six FROM docs, unnest(range(n - 5)) AS t(i)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND x.i < y.i AND x.six = y.six),
islands AS (SELECT r, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island),
runs AS (SELECT r, s AS start, e - s AS length, min(q) AS period FROM islands WHERE e - s >= greatest(12, 2 * q) GROUP BY r, s, e),
per AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         min((-length, start, period)) AS best FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, i FROM runs, unnest(range(start + period, start + length)) AS t(i)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT r, i, w[i + 1] AS word FROM docs, unnest(range(n)) AS t(i)) ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[2]::BIGINT AS start, (-best[1])::BIGINT AS length, best[3]::BIGINT AS period,
  (-1000 * best[1] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""
