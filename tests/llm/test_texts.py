"""Operators on texts against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, decontaminate, pseudolikelihood, quality, simhash, suffixdedup, suffixsort, tokenstore

DOCS = "doc_id long, text string"
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY, n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, empty, null and long texts, repeated and clashing ids."""
    rng = np.random.default_rng(3)
    base = [prose(rng, int(n)) for n in rng.integers(1, 200, 60)]
    passage = prose(rng, 40)
    out = [*base, *base[:20], *(t + " tail" for t in base[:10]), *(prose(rng, 9) + " " + passage + " " + prose(rng, 9) for _ in range(8))]
    out += ["", None, "\u00e9\u00df " * 60, "a" * 400, "ab" * 300, prose(rng, 60_000), "X y", "x Y", " x\ty "]
    rows = list(enumerate(out))
    return [*rows, (5, out[5]), (5, "another text of five"), (None, out[7]), (None, None)]


# --- SimHash ---


def fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps):
    """doc_id of each row's component by union over all pairs."""
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return [find(f) for f in fps]


def test_simhash(spark, texts):
    few = [r for r in texts if r[1] is None or len(r[1]) < 3000]
    rows = simhash.near_duplicates(spark.createDataFrame(few, DOCS).withColumn("fp", F.lit("clash"))).collect()
    assert len(rows) == len(few)
    fps = {}
    for i, t in few:
        fps.setdefault(i, []).append(fingerprint(t))
    flat = [f for x in fps.values() for f in x]
    ids = [i for i, x in fps.items() for _ in x]
    roots = grouped(flat)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((-1 if i is None else i, f, least.get(r, -1)) for i, f, r in zip(ids, flat, roots, strict=True))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fp"] % 2**64, -1 if r["component_id"] is None else r["component_id"]) for r in rows) == want


def test_links_are_complete(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 30)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 4), replace=False)) for b in base for _ in range(40)}
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1080), 1000), 5000: 5000, 5001: 5000}


# --- decontamination ---

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_contamination(text, items):
    norm = lambda t: re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, found = norm(text), set(), set()
    windows = {}
    for item, t in items:
        iw = norm(t)
        n = min(13, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            windows.setdefault(n, {}).setdefault(tuple(iw[i : i + n]), set()).add("null" if item is None else str(item))
    for n, known in windows.items():
        for i in range(len(ws) - n + 1):
            if own := known.get(tuple(ws[i : i + n])):
                hit |= set(range(i, i + n))
                found |= own
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("group", [4 << 20, 100])
def test_decontamination(spark, texts, monkeypatch, group):
    monkeypatch.setattr(decontaminate, "MAX_GROUP_BYTES", group)
    rng = np.random.default_rng(9)
    some = [t for _, t in texts if t and 100 < len(t) < 3000]
    items = [(i, " ".join(t.split()[3:30])) for i, t in enumerate(some[::4])] + [(100, "x y"), (101, ""), (None, "another TEXT"), (102, None), (103, prose(rng, 30)), (10, some[0]), (10, some[0])]
    few = [*texts, (400, (some[1] + "! ") * 3)]
    docs = spark.createDataFrame(few, DOCS).withColumn("n_hit", F.lit("clash")).withColumn("a.b", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(docs, bench).select("doc.text", "n_words", "n_hit", "items").collect()
    assert len(got) == len(few)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute_contamination(r["text"], items)
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_decontamination_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], DOCS)
    assert decontaminate.decontaminated(docs, none).count() == 2
    assert decontaminate.decontaminated(docs.limit(0), none).count() == 0


# --- token store ---


def test_token_store(spark, texts):
    odd = ["<|endoftext|> in", "two  blanks", " lead", "tail ", "line\n\nbreaks \n x", "it's 12,345% \u3000 wide", "\n"]
    rows = [*texts, *((1000 + i, t) for i, t in enumerate(odd))]
    rows = [r for i, r in enumerate(rows) if r[0] is not None and r[0] not in {x[0] for x in rows[:i]}] + [(None, "first")]
    got = tokenstore.store(spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("clash")), shard_tokens=5000).collect()
    whole = tokenstore.Encoder(tokenstore.default_tokenizer()).tokenizer
    at, by_id = 0, {r["doc_id"]: r for r in got}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.append(np.array(whole.encode(text or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        r = by_id[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(got) == len(rows)


def test_token_store_keeps_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b"), (1, "a b"), (1, None), (None, None), (None, None)]
    got = tokenstore.store(spark.createDataFrame(rows, DOCS)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1, 1] and got[-1]["start"] + got[-1]["n_tokens"] == 2 + 7
    assert tokenstore.store(spark.createDataFrame([], DOCS)).count() == 0


def test_repair_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = rng.integers(1, 3000)
        ids = rng.integers(0, rng.integers(1, 60), n).astype("<u4")
        cuts = np.unique(np.append(rng.integers(1, n + 1, 5), n))
        docs = np.split(ids, cuts[:-1])
        shard = tokenstore._shard(0, 0, list(range(len(docs))), docs, 50_257, 6)
        for j, doc in enumerate(docs):
            a, b = sorted(rng.integers(0, len(doc) + 1, 2))
            assert (tokenstore.read_ids(shard, j) == doc).all()
            assert (tokenstore.read_ids(shard, j, a, b) == doc[a:b]).all()
    same = np.full(4000, 7, "<u4")
    s, ends, rules, _ = tokenstore.repair(same, np.array([4000]), 50_257, rounds=8)
    assert len(s) < 100 and len(rules) <= 8 and ends[0] == len(s)


# --- suffix arrays ---


def brute_repeats(rows):
    seen, out = set(), {}
    for key in sorted({(i is not None, i or 0, order, (t or "").encode()) for i, t, order in rows}):
        b = key[3]
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[key[0], key[1], b] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "piece", "batch"), [(20_000, 1 << 17, 10_000), (3, 1000, 7)])
def test_repeated_strings(spark, texts, monkeypatch, hot, piece, batch):
    monkeypatch.setattr(suffixdedup, "PIECE", piece)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        few = [*texts, *((None, f"{i} " + texts[3][1] * 3) for i in range(30))]  # with the 60,000-word text, and many texts without an id
        docs = spark.createDataFrame(few, DOCS).withColumn("at", F.lit("clash"))
        order = {r["t"]: r["x"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("x")).collect()}
        want = brute_repeats([(i, t, order[t or ""]) for i, t in few])
        got = suffixdedup.remove_repeats(docs, hot=hot).collect()
        assert len(got) == len(few)
        seen = {}
        for r in got:
            seen.setdefault((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"]), []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
            assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]
        for i, t in few:
            assert want[i is not None, i or 0, (t or "").encode()] in seen[i is not None, i or 0, len((t or "").encode())]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_repeated_strings_empty_table(spark):
    assert suffixdedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(400):
        n = rng.integers(1, 60)
        t = rng.integers(97, 97 + rng.integers(1, 4), n).astype(np.uint8)
        want = rng.random(n) < rng.random()
        order, s = suffixsort.suffix_order(t, want, 64), t.tobytes()
        assert order.tolist() == sorted(np.flatnonzero(want).tolist(), key=lambda i: s[i:])
        shared = suffixsort.common_prefixes(t, order, 20)
        for i in range(1, len(order)):
            a, b = s[order[i - 1] :], s[order[i] :]
            assert shared[i] == next((k for k in range(20) if k >= min(len(a), len(b)) or a[k] != b[k]), 20)


# --- quality ---


def labelled_docs(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = prose(rng, int(rng.integers(5, 80))).capitalize() + "."
        rows.append((i, t.replace(" ", "%%% ") if bad else t))
        labels.append((i, int(not bad), 0))
    return rows, labels


def test_quality(spark):
    rows, labels = labelled_docs(np.random.default_rng(2))
    rows += [(700, None), (701, ""), (None, "no id here"), (3, "repeated id"), (702, "long " * 100_000)]
    labels += [(700, None, None), (None, 1, 1), (3, 0, 0), (9999, 1, 0), (5, 7, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("stats", F.lit("clash")).withColumn("score", F.lit(1))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.scored(docs, table).select("doc.doc_id", "doc.text", F.col("score")).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and r["doc_id"] != 3 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in held]) > 0.98
    kept = quality.accepted(docs, table)
    assert kept.columns == docs.columns


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    assert [r["score"] for r in quality.scored(docs, none).collect()] == [0.5, 0.5]
    assert quality.accepted(docs.limit(0), none).count() == 0


def test_lasso_finds_the_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, len(quality.NAMES)))
    y = ((x[:, 3] > 0.5) & (x[:, 5] <= 0.7)).astype(float)
    bias, rules = quality.fit(x, y)
    score = bias + sum(w * quality.fires(r, x) for w, r in rules)
    assert ((score > 0) == (y > 0)).mean() > 0.99
    assert len(rules) < len(quality.grow_rules(x, y))


# --- pseudo-likelihood ---


def test_pseudo_likelihood_learns_and_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"a{j % 7}" for j in range(int(k), int(k) + 60))) for i, k in enumerate(rng.integers(0, 7, 300))]
    rows += [(400, ""), (401, None), (None, "a1 a2 a3"), (402, "a1 a2 a3"), (403, " ".join(rng.permutation([f"a{j % 7}" for j in range(60)]))), (404, "a1 " * 40_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in pseudolikelihood.scored(docs, rounds=(1, 1, 1)).collect()}
    assert got[400]["log_likelihood"] == got[401]["log_likelihood"] == 0 and got[400]["mean_log_likelihood"] is None
    assert got[None]["log_likelihood"] == pytest.approx(got[402]["log_likelihood"])
    assert got[404]["n_tokens"] == 40_000
    assert np.mean([got[i]["mean_log_likelihood"] for i in range(300)]) > got[403]["mean_log_likelihood"] + 0.5
    assert pseudolikelihood.scored(docs.limit(0)).count() == 0


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(float) for k, v in pseudolikelihood.first_weights().items()}
    t = rng.integers(0, pseudolikelihood.IDS, 40)
    around = pseudolikelihood.windows(t, np.array([0, 15, 15, 40]))
    for k, g in pseudolikelihood.gradients(w, t, around).items():
        at = tuple(rng.choice(np.argwhere(np.abs(g) > 1e-5)))
        old = w[k][at]
        found = []
        for step in (1e-5, -1e-5):
            w[k][at] = old + step
            found.append(-pseudolikelihood.log_probs(w, t, around).mean())
        w[k][at] = old
        assert (found[0] - found[1]) / 2e-5 == pytest.approx(g[at], rel=1e-2)


def test_scores_against_brute_force(spark, monkeypatch):
    """Sums of log-probabilities over whole texts, word by word, with shares that are held and others that are joined."""
    monkeypatch.setattr(pseudolikelihood, "TOP", 1792)
    rng = np.random.default_rng(6)
    rare = [f"x{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(VOCABULARY + rare, int(rng.integers(1, 120))))) for i in range(120)]
    rows += [(500, "%%% ### $$$"), (501, "long" * 100 + " tail"), (502, None), (503, "  "), (504, rows[0][1].upper()), (505, " \t x1\u00a0x2 \n\x0bX1\x1c "), (506, ""), (507, "x1")]
    docs = spark.createDataFrame(rows, DOCS)
    counts = pseudolikelihood.word_counts(docs.select("text"))
    v = pseudolikelihood.vocabulary(counts, 2000)
    assert len(v.words) <= 2000 or len(v.words) == counts.count()
    w = pseudolikelihood.trained(docs, spark.sparkContext.broadcast(v))
    n = {r["word"]: r["n"] for r in counts.collect()}
    by = {i: x for i, x in enumerate(v.words.to_pylist()[: pseudolikelihood.TOP])}
    ids = {bytes(x): i for i, x in by.items()}
    total = {}
    for word, k in n.items():
        if bytes(word) not in ids:
            total[zlib.crc32(word) % pseudolikelihood.BUCKETS] = total.get(zlib.crc32(word) % pseudolikelihood.BUCKETS, 0) + k
    got = {r["doc_id"]: r for r in pseudolikelihood.scored(docs, held_words=2000).collect()}
    for i, text in rows:
        words = [w if len(w) <= 64 else b"\0" + hashlib.blake2b(w, digest_size=16).digest() for w in (text or "").encode().lower().split()]
        t = [ids.get(x, pseudolikelihood.TOP + zlib.crc32(x) % pseudolikelihood.BUCKETS) for x in words]
        want = 0.0
        for j, (x, word) in enumerate(zip(t, words, strict=True)):
            around = [t[k] if 0 <= k < len(t) else pseudolikelihood.IDS for k in (j - 2, j - 1, j + 1, j + 2)]
            h = np.tanh(w["embed"][around].reshape(-1) @ w["w1"] + w["b1"])
            c, of = divmod(x, pseudolikelihood.SIZE)
            for z, at in ((h @ w["wc"] + w["bc"], c), (h @ w["ww"][c] + w["bw"][c], of)):
                want += z[at] - np.log(np.exp(z - z.max()).sum()) - z.max()
            if word not in ids:
                want += np.log(n[word] / total[zlib.crc32(word) % pseudolikelihood.BUCKETS])
        assert got[i]["n_tokens"] == len(words)
        assert got[i]["log_likelihood"] == pytest.approx(want, abs=1e-2, rel=1e-4)


def test_model_beats_frequencies_and_does_not_depend_on_the_files(spark, monkeypatch):
    monkeypatch.setattr(pseudolikelihood, "LOT_TOKENS", 150_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held_out = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(5)) == 0
    v = pseudolikelihood.vocabulary(pseudolikelihood.word_counts(docs.where(~held_out).select("text")))
    words = spark.sparkContext.broadcast(v)
    found = []
    for n in (1, 16):
        found.append(pseudolikelihood.trained(docs.where(~held_out).repartition(n), words))
    assert all(np.allclose(found[0][k], found[1][k], atol=1e-5) for k in found[0])
    runs = list(pseudolikelihood._runs([pa.array([r["text"] for r in docs.where(held_out).collect()])], v))
    tokens = np.concatenate([t for t, _ in runs])
    plain = np.log((v.frequency + 0.5) / (v.frequency + 0.5).sum())[tokens].mean()
    assert sum(pseudolikelihood.log_probs(found[0], *r).sum() for r in runs) / len(tokens) > plain + 0.05
