"""Nearest neighbours by multi-index hashing (operator 2).

1. Rotations are learned (iterative quantisation) on a bounded sample; the signs
   of a rotated vector are its code of ``BITS`` bits.  Largest inner product
   becomes smallest angle by one more component that lifts every vector to the
   largest norm.
2. Rows with equal vectors are one class with its k + 1 smallest ids, which is
   all that any result can use; so copies cost nothing and none is lost.
3. Queries and classes meet in blocks of bounded size.  A block splits its codes
   into ``TABLES`` substrings and indexes each: a bucket is a bitmap of the rows
   with that substring.  A code within radius r of the query has a substring
   within r // TABLES, so the buckets that near hold every code within r.  Their
   union is kept under each key, once for a block and number of flips, so a
   query looks up one entry of each table; full distances are then verified and
   floats reranked.
4. The radius is set on the sample so that 97 of 100 true neighbours lie in it;
   where a block yields fewer than k codes the radius grows until it does.

Each query's best of all blocks are merged by rank in Spark.  Work is queries
times rows, in blocks, with the inner loop on a few bytes per code.

Defined cases: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part, nor do rows with a null
vec_id; rows that repeat vec_id and vector count once; with fewer candidates
than k all are returned; an empty table gives no rows.  Ties go to the smaller
vec_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

K, EVERY = 20, 20
BITS, TABLES, SAMPLE_ROWS, REACH, SEED = 128, 16, 4096, 0.97, 11
BLOCK_ROWS, BLOCK_QUERIES = 8192, 16_384


class Codes:
    """Learned rotations and the search radius; a few hundred KB at most for a thousand components."""

    def __init__(self, sample: np.ndarray, norm: float, n_rows: int, k: int):
        rng = np.random.default_rng(SEED)
        self.norm = norm
        x = self.lifted(sample)
        self.mean = x.mean(axis=0)
        c = x - self.mean
        _, _, axes = np.linalg.svd(c, full_matrices=False)
        axes = axes[:BITS].T
        v, parts = c @ axes, []
        for _ in range(math.ceil(BITS / axes.shape[1])):
            r = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))[0]
            for _ in range(30):
                u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            parts.append(axes @ r)
        self.turn = np.hstack(parts)[:, :BITS]
        # as many neighbours of the sample as k are of all rows
        near = max(1, math.ceil(k * len(sample) / max(n_rows, 1)))
        asked = rng.permutation(len(sample))[:256]
        scores = sample[asked] @ sample.T
        scores[np.arange(len(asked)), asked] = -np.inf
        best = np.argpartition(-scores, min(near, len(sample) - 1), axis=1)[:, :near]
        code, ask = self.code(x), self.code(self.lifted(sample[asked], query=True))
        far = np.bitwise_count(code[best] ^ ask[:, None, :]).sum(axis=2)
        self.radius = int(np.quantile(far, REACH, method="higher"))

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x**2).sum(axis=1)))
        return np.hstack([x, more[:, None]])

    def code(self, lifted: np.ndarray) -> np.ndarray:
        """n x TABLES substrings of eight bits."""
        bits = np.zeros((len(lifted), BITS), bool)
        bits[:, : self.turn.shape[1]] = (lifted - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1)


class Block:
    """The substring tables of one block of codes, whose bytes are the substrings.

    A table holds a bit of each row under each of 256 keys: 4 MB a number of flips for 16 tables and 8,192 rows.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes).view(np.uint8)
        self.whole = np.ascontiguousarray(self.codes.view(np.uint64).T)
        n, tables = self.codes.shape
        exact, rows = np.zeros((tables, 256, -(-n // 64) * 8), np.uint8), np.arange(n)
        for j in range(tables):
            held = np.zeros((256, n), bool)
            held[self.codes[:, j], rows] = True
            exact[j, :, : -(-n // 8)] = np.packbits(held, axis=1)
        self.flipped = [exact.view(np.uint64)]

    def table(self, flips: int) -> np.ndarray:
        """table x key: the rows whose substring differs from the key in at most ``flips`` bits."""
        while len(self.flipped) <= flips:
            last = self.flipped[-1]
            more = last.copy()
            for bit in range(8):
                more |= last[:, np.arange(256) ^ (1 << bit)]
            self.flipped.append(more)
        return self.flipped[flips]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits."""
        key = code.view(np.uint8)
        each, more = divmod(radius, len(key))
        far, near = np.arange(more + 1), np.arange(more + 1, len(key))  # if all substrings differed by more, the sum would exceed the radius
        seen = np.bitwise_or.reduce(self.table(min(each, 8))[far, key[far]], axis=0)
        if each and len(near):
            seen |= np.bitwise_or.reduce(self.table(min(each - 1, 8))[near, key[near]], axis=0)
        rows = np.flatnonzero(np.unpackbits(seen.view(np.uint8), count=len(self.codes)))
        far = sum(np.bitwise_count(word[rows] ^ own).astype(np.int16) for word, own in zip(self.whole, code.view(np.uint64), strict=True))
        return rows[far <= radius]

    def nearest(self, code: np.ndarray, radius: int, k: int) -> np.ndarray:
        while len(rows := self.within(code, radius)) < min(k, len(self.codes)):
            radius += TABLES
        return rows


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def usable(v: Column, dim: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return v.isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row of ``vectors`` (vec_id, embedding) with ``is_query``."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    lengths = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("n")).count()
    if (most := lengths.orderBy(F.desc("count"), F.desc("n")).first()) is None:
        return spark.createDataFrame([], result)
    dim = most["n"]
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), dim)).select("vec_id", "embedding").distinct()
    by_vector = Window.partitionBy("embedding").orderBy("vec_id")
    classes = rows.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    classes = classes.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = saved(classes.select(F.element_at("ids", 1).alias("cid"), "ids", "embedding"), "classes")
    length2 = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n_rows, top = classes.agg(F.count("*"), F.max(length2)).first()
    if not n_rows:
        return spark.createDataFrame([], result)
    asked = rows.where(is_query).join(classes.select("cid", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("cid").alias("asks"))
    asked = saved(asked, "asked")
    ask = asked.select("asks").distinct().join(classes.select(F.col("cid").alias("asks"), F.col("embedding").alias("asked")), "asks")
    n_x, n_q = (max(1, math.ceil(n / size)) for n, size in ((n_rows, BLOCK_ROWS), (asked.count(), BLOCK_QUERIES)))
    sample = classes.orderBy(F.xxhash64(F.lit(SEED), "cid"), "cid").limit(SAMPLE_ROWS).select("embedding").toArrow()
    held = spark.sparkContext.broadcast(Codes(_matrix(sample["embedding"], dim), math.sqrt(top), n_rows, k))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"asks": [], "cid": [], "score": []}
        if left.num_rows and right.num_rows:
            codes, x, q = held.value, _matrix(left["embedding"], dim), _matrix(right["asked"], dim)
            block, cid = Block(codes.code(codes.lifted(x))), left["cid"].to_numpy()
            for asks, v, code in zip(right["asks"].to_pylist(), q, codes.code(codes.lifted(q, query=True)), strict=True):
                at = block.nearest(code, codes.radius, k + 1)
                score = (x[at] * v).sum(axis=1)
                if len(at) > k + 1:  # the k + 1 largest and their ties
                    top = score >= np.partition(score, -k - 1)[-k - 1]
                    at, score = at[top], score[top]
                best = np.lexsort((cid[at], -score))[: k + 1]
                out["asks"] += [asks] * len(best)
                out["cid"] += cid[at][best].tolist()
                out["score"] += score[best].tolist()
        return pa.table(out, schema=pa.schema([("asks", pa.int64()), ("cid", pa.int64()), ("score", pa.float64())]))

    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = classes.select("cid", "embedding", spread("cid", n_x).alias("xb"), every(n_q).alias("qb"))
    right = ask.select("asks", "asked", spread("asks", n_q).alias("qb"), every(n_x).alias("xb"))
    met = left.groupBy("xb", "qb").cogroup(right.groupBy("xb", "qb")).applyInArrow(meet, "asks long, cid long, score double")
    by_score = Window.partitionBy("asks").orderBy(F.desc("score"), "cid")
    best = met.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= k + 1)
    best = best.join(classes.select("cid", "ids"), "cid").select("asks", "score", F.explode("ids").alias("id"))
    entry = F.struct((-F.col("score")).alias("far"), F.col("id"), F.col("score"))
    lists = best.groupBy("asks").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("near"))
    own = asked.join(lists, "asks").select("query_id", F.slice(F.filter("near", lambda e: e["id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("at", "e")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("vec_id"), "e.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return search(vectors, F.col("vec_id") % EVERY == 0)
