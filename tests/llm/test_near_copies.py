"""Near copies of the pipeline against brute force."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import simhash

DOCS = "doc_id long, text string"


def prose(rng, n):
    return " ".join(f"w{i}" for i in rng.integers(0, 3000, n))


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, edits):
    w = text.split()
    for i in rng.choice(len(w), edits, replace=False):
        w[i] = f"new{rng.integers(1 << 40)}"
    return " ".join(w)


def brute_groups(texts):
    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("leaders", [3, 0, 1])
def test_near_copies_against_brute_force(spark, monkeypatch, leaders):
    monkeypatch.setattr(simhash, "LEADERS", leaders)
    rng = np.random.default_rng(5)
    base = [prose(rng, 200) for _ in range(40)]
    # 1 to 6 edited words of 200: similarity of about 0.95 down to 0.74; then a large group around one text
    texts = [*base, *(edited(rng, t, 1 + i % 6) for i, t in enumerate(base)), *(edited(rng, base[0], 3) for _ in range(60)), "", None, " \n", "Short  text", "short text", "other short"]
    want = brute_groups(texts)
    assert 40 < len(set(want)) < 60
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    got = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want))


@pytest.mark.parametrize("n", [5, 10, 23, 24, 47, 48, 100, 191, 200, 700, 1535, 1600])
def test_recall_at_the_least_similarity(n):
    rng = np.random.default_rng(n)
    met = near = 0
    tries = 500 if n < 500 else 200
    fresh = lambda k: rng.integers(0, 1 << 64, k, dtype=np.uint64)
    for _ in range(tries):
        # a text and one with a fifth of its shingles gone; two that have 0.8 of all in common
        gone, both = n - n // 5, -(-8 * n // 9)
        h, own = fresh(n), (fresh(0) if rng.random() < 0.5 else fresh(n - both))
        other = h[:gone] if not len(own) else np.append(h[:both], own)
        a, b = np.unique(h), np.unique(other)
        assert simhash.similar(a.tobytes(), b.tobytes())
        met += len(np.intersect1d(simhash.block_keys(a), simhash.block_keys(b))) > 0
        near += np.bitwise_count((simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)).view(np.uint64)).sum() <= max(simhash.far(len(a)), simhash.far(len(b)))
    assert met >= tries * 0.99
    assert near >= tries * 0.99


def test_fingerprints_of_unlike_texts_are_far():
    rng = np.random.default_rng(8)
    wide = [simhash.wide_fingerprint(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))) for n in rng.integers(20, 400, 100)]
    far = [np.bitwise_count((a ^ b).view(np.uint64)).sum() for i, a in enumerate(wide) for b in wide[:i]]
    assert min(far) > simhash.far(20)


def test_ids_do_not_identify_groups(spark):
    rng = np.random.default_rng(7)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (7, c), (7, d), (9, d), (None, e), (3, e), (7, c)]
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.near_duplicates_stage(spark, docs, "")
    assert sorted(got.collect(), key=str) == sorted(spark.createDataFrame([(None, a), (None, b), (7, c), (7, d), (3, e)], DOCS).collect(), key=str)
    assert corpus_pipeline.near_duplicates_stage(spark, docs.limit(0), "").count() == 0
