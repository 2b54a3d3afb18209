"""Periodic runs against all stretches of all periods, one by one."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import periodicruns as pr

WORDS = r"[^\x20\x09-\x0D]+"


def plain_runs(words, least=12):
    """start, length, period by definition: every period, every maximal stretch, the smallest period of each."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_collapsed(words, runs):
    out = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in out)


def found(docs, least=12):
    codes = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
    w = np.array([codes[x] for d in docs for x in d], np.int64)
    doc, start, length, period = pr.find_runs(w, np.cumsum([0, *map(len, docs)]), least)
    out = [[] for _ in docs]
    for d, *run in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        out[d].append(tuple(run))
    return out


block = st.builds(lambda unit, times, tail: (unit * times + unit)[: len(unit) * times + tail], st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 5))
texts = st.lists(st.one_of(block, st.lists(st.sampled_from("abcdefgh"), max_size=12)), max_size=7).map(lambda parts: [w for p in parts for w in p])


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4), st.sampled_from([2, 5, 12]))
def test_as_by_definition(docs, least):
    assert found(docs, least) == [plain_runs(d, least) for d in docs]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=120))
def test_two_words_only(words):
    assert found([words], 2) == [plain_runs(words, 2)]


def test_made_texts():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    rng = np.random.default_rng(3)
    docs = [
        list(fibonacci[-1]), ["x"] * 700, list("ab" * 300), list("aab" * 100 + "b" + "aab" * 60), list("axayaz" * 3) + [str(i // 2 if i % 2 else -1) for i in range(400)],
        [str(x) for x in rng.integers(0, 3, 500)], [*map(str, range(100)), *map(str, range(100)), *map(str, range(60))], ["y"] * 11, ["y"] * 12, [],
    ]
    assert found(docs) == [plain_runs(d) for d in docs]


def test_long_texts_take_linear_steps():
    """The same word, and a period, over 200,000 words: found as one run each."""
    n = 200_000
    doc, start, length, period = pr.find_runs(np.concatenate([np.zeros(n, np.int64), np.arange(n) % 701 + 1]), np.array([0, n, 2 * n]))
    assert (doc.tolist(), start.tolist(), length.tolist(), period.tolist()) == ([0, 1], [0, 0], [n, n], [1, 701])


def test_planted():
    for i in [*range(200), None]:
        words = [str(k).encode() for k in range(50)]
        h = zlib.crc32(str(i if i is not None else "null").encode())
        g = h // 10
        want = list(words)
        if h % 10 == 0:
            a = g % 50
            p = 1 + (50 - a) // (3 + g % 8)
            want = [words[a + (k - a) % p] if k >= a else words[k] for k in range(50)]
        assert pr.planted(None if i is None else str(i), words) == want
        assert pr.planted(str(i), []) == []


def test_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing and dotted columns."""
    texts = [None, "", " \t\n", "one", "go " * 30, "a b c " * 9 + "d", "x\x0by\x0cz\r" * 8, "é ü " * 9, "la " * 20000, " ".join(map(str, range(3000)))]
    rows = [(i if i % 3 else None, t, "x", i) for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, `doc.id` int")
    got = pr.searched(docs).select("doc.*", "n_words", "collapsed", pr.F.col("runs").alias("found")).collect()
    assert len(got) == len(rows)
    for r in got:
        words = (r["text"] or "").split()
        want = [(0, 20000, 1)] if len(words) == 20000 else plain_runs(words)  # the plain search would take minutes
        assert r["n_words"] == len(words) and [tuple(x) for x in r["found"]] == want and r["collapsed"] == plain_collapsed(words, want)
    assert pr.searched(docs.limit(0)).collect() == []


def test_query(spark, tmp_path):
    """The contract's columns, from its own words."""
    texts = [f"{'w ' * (i % 5)}" + " ".join(str((i * k) % (7 + i)) for k in range(4 * i)) for i in range(80)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (90, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pr.query(spark, str(tmp_path)).collect()}
    assert len(got) == 82
    for i, t in [*enumerate(texts), (90, "")]:
        words = [w.decode() for w in pr.planted(str(i), t.encode().split())]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        milli = 1000 * best[1] // best[2] if runs else None
        assert tuple(got[i]) == (i, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(plain_collapsed(words, runs)))
    assert any(r["n_runs"] for r in got.values())
