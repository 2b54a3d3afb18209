"""Nearest neighbours, the registered queries and the pipeline."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, neighbours, queries, quality
from tidemark.llm.common import saved, table

from .test_near_copies import brute_groups

DATA = "/root/testdata/sf0.001"


def brute_nearest(rows, k=20):
    x = np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = (x * np.array(v)).sum(axis=1)
            best = sorted((-a, j) for a, (j, _) in zip(s, rows, strict=True) if j != i)[:k]
            out[i] = [(j, -a) for a, j in best]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16)) * rng.uniform(0.5, 2, (900, 1))
    x[7] *= 2
    x[100:400] = x[7]  # one vector held by a third
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 3), (2080, [None] + [1.0] * 15), (None, [1.0] * 16), (20, rows[20][1])]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_nearest(rows)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert all(s == pytest.approx(float(np.dot(np.float32(x[q]).astype(float), np.float32(x[i]).astype(float)))) for q, v in got.items() for i, s in v)
    assert [i for i, _ in got[200]] == [7, *range(100, 119)]  # ties to the smaller ids
    assert all(v == sorted(v, key=lambda r: (-r[1], r[0])) for v in got.values())


@pytest.mark.parametrize("n", [0, 1, 5])
def test_neighbours_of_few(spark, n):
    vectors = spark.createDataFrame([(20 * i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    got = neighbours.search(vectors, F.col("vec_id") % 20 == 0).collect()
    assert len(got) == n * (n - 1)


def test_every_code_in_the_radius_is_found():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, neighbours.TABLES)).astype("<u2")
    codes[250:] = codes[:250] ^ (1 << rng.integers(0, 16, (250, neighbours.TABLES))).astype("<u2")
    block = neighbours.Block(codes)
    for q in codes[::25]:
        far = np.bitwise_count(codes ^ q).sum(axis=1)
        for radius in (0, 3, 8, 21, 60):
            assert block.within(q, radius).tolist() == np.flatnonzero(far <= radius).tolist()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, name):
    made = queries.QUERIES[name](spark, DATA)
    rows = made.toPandas()
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(rows.columns)
    # whole numbers among which there are NULLs are floats in one library's frames and not in the other's
    whole = [c for c, t in made.dtypes if t in ("int", "bigint")]
    rows, want = (df.astype(dict.fromkeys(whole, "Int64")) for df in (rows, want))
    plain = lambda df: sorted(map(repr, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    assert plain(rows) == plain(want)


def test_pipeline_stages(spark):
    docs = table(spark, DATA, "documents")
    labels, bench = table(spark, DATA, "labels"), table(spark, DATA, "benchmark")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, DATA), name)
        seen[name] = (docs, out)
        if name != "tokens":
            assert out.columns == columns
            assert out.exceptAll(docs.dropDuplicates() if name != "mix" else out).count() == 0
        docs = out
    before, after = seen["quality"]
    score = quality.scored(before, labels).where("score >= 0.5").count()
    assert after.count() == score
    before, after = seen["near_duplicates"]
    rows = before.orderBy("doc_id").select("doc_id", "text").collect()
    roots = brute_groups([r["text"] for r in rows])
    assert sorted(r["doc_id"] for r in after.collect()) == [rows[i]["doc_id"] for i in sorted(set(roots))]
    before, after = seen["decontaminate"]
    assert after.count() == before.count() - decontaminate.judge(before, bench).where(decontaminate.contaminated()).count()
    before, after = seen["mix"]
    assert seen["tokens"][1].count() == after.count() > 0
    assert corpus_pipeline.run(spark, DATA).count() == seen["tokens"][1].count()


ODD = [(1, "plain words of a text that is kept.", "en", "a", 1), (1, "plain words of a text that is kept.", "en", "a", 1), (2, "", "en", "a", 0), (3, None, None, None, None), (None, "no id here but words, some words.", "de", "b", 3), (None, None, "en", "b", 0), (4, "long text " * 30_000, "en", "b", 7)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_of_odd_and_of_no_rows(spark, tmp_path, rows):
    """Nulls, repeats, long texts, names with a dot and names that the stages use themselves."""
    clash = ["doc", "stats", "score", "node", "row", "copies", "n_hit", "key", "a.b", "text_"]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("own") for c in clash})
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)][: len(rows)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "words that no text holds at all")][: len(rows)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, str(tmp_path)), name)
        if name != "tokens":
            assert out.columns == docs.columns
            assert not rows or out.where("`a.b` = 'own' AND node = 'own'").count() == out.count() > 0
        assert rows or out.count() == 0
        docs = out


def test_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 150)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(3)
    rows = [(i, v.astype(np.float32).astype(float).tolist()) for i, v in enumerate(rng.standard_normal((700, 12)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cid", F.lit("clash"))
    got = {}
    for r in neighbours.search(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = brute_nearest(rows)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
