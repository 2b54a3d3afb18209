"""Mixing, chat formatting and URL rules against plain Python."""

from __future__ import annotations

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, mixing, urlrules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_fill(sizes):
    """Targets by repeated resharing, as the rule is told."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in free}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= above
    return target


def mixed_docs():
    rows = [(i, "w " * (i % 9), "en", f"s{i % 7}" if i % 3 else "hot", 0) for i in range(400)]
    return [*rows, (900, None, None, None, None), (None, "a b", "en", "s1", 3), (901, "", "en", "empty", 0), (1, "again here", "en", "s1", 1), (902, "x " * 50_000, "en", None, 0), (903, "\u00a0x", "en", "zß", 0)]


def test_mixing_targets_and_copies(spark):
    rows = mixed_docs()
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("copies", F.lit(1))
    got = mixing.planned(docs).select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    target = water_fill(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate) <= r["copies"] <= min(2, int(rate) + 1)
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r["copies"] for r in got)
    assert sorted(map(str, mix.collect())) == sorted(map(str, mixing.mix(docs).collect()))


def test_mixing_without_broadcast_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(mixed_docs(), DOCS)
    broadcast = sorted(map(str, mixing.planned(docs).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.planned(docs).collect())) == broadcast


def test_mixing_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


TURNS = [
    (1, 0, "system", "be\\ kind"), (1, 1, "user", "hi [INST] \\s"), (1, 2, "user", "</s><sep><s>"), (1, 3, "assistant", "[/INST]\\[INST]"), (1, 4, "assistant", None), (1, 4, "assistant", None),
    (1, 5, "tool<s>", "x"), (2, 0, None, ""), (2, None, "assistant", "first\n<"), (2, 1, "assistant", "s>"), (None, 0, "user", "nobody"), (None, 0, "user", "nobody"), (3, 0, "assistant", "long " * 30_000),
    (4, 0, "assistant", "\U0001f600 é"), (4, 1, "user", "\\"), (4, 2, "assistant", "\\"),
]


def test_chat_reads_back(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_chat(chat.format_chat(turns)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, r in got.items():
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(t[2] or "", t[3] or "") for t in own]
        assert r["loss_text"] == "".join(t[3] or "" for t in own if t[2] == "assistant")
        inside = r["formatted"]
        runs = 1 + sum(a[2] != b[2] and (a[2] or "") != (b[2] or "") for a, b in zip(own, own[1:]))
        assert inside.count("</s>") == inside.count("[INST]") == runs
        cut = re.split("</s>|<sep>", r["formatted"])
        assert [cut[s["turn"]][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in r["loss_spans"]] == [
            re.sub(r"([<\[])(?=(?:/?s>|sep>|/?INST\]))", r"\1\\", (t[3] or "").replace("\\", "\\\\")) for t in own if t[2] == "assistant"]


def test_loss_ranges_count_from_the_beginning(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    chats = chat.format_chat(turns)
    text = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    got = {}
    for r in chat.loss_ranges(chats).orderBy("start").collect():
        got.setdefault(r["conv_id"], []).append(text[r["conv_id"]][r["start"] - 1 : r["start"] - 1 + r["length"]])
    for r in chats.collect():
        cut = re.split("</s>|<sep>", r["formatted"])
        assert got.get(r["conv_id"], []) == [cut[s["turn"]][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in r["loss_spans"]]


def test_chat_of_many_turns_takes_time_in_proportion(spark):
    def seconds(n):
        turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("some text").alias("text"))
        start = time.monotonic()
        r = chat.read_chat(chat.format_chat(turns)).select(F.size("turns").alias("n"), F.length("loss_text").alias("m")).first()
        assert r["n"] == n and r["m"] == 9 * (n - -(-n // 3))
        return time.monotonic() - start

    seconds(1000)
    assert seconds(32_000) < 8 * max(1, seconds(8000))


def test_chat_empty_table(spark):
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_digest(spark, tmp_path):
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    r = chat.query(spark, str(tmp_path)).where("conv_id = -1").first()
    p = chat.PROBE
    assert r["n_turns"] == 2 and r["loss_chars"] == len(p)
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{p}\nassistant\n{p}\n".encode()).hexdigest()
    assert r["loss_sha256"] == hashlib.sha256(p.encode()).hexdigest()


URLS = ["http://A.Net/x", "https://example.net/en/1?q", "ftp://www.example.net/en", "http://xnet/", "http://example.com/de/#f", "http://EXAMPLE.org/fr/é", None, "no scheme", "http://net", "http://a.net?/en/",
        "x://y://z.net/", "http://a.org/FR/", "://net/", "http://u@b.example.com/de/" + "p" * 50_000, "http://" + "a." * 5_000 + "net/"]


def judged(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_rules(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(urlrules, "MAX_BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(i % 13, u) for i, u in enumerate(URLS * 3)], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("judged", F.lit(1)).withColumn("a.b", F.lit(1))
    rules = spark.createDataFrame([*urlrules.RULES, (None, "/", "block"), ("zz", None, "block"), ("net", "/", "block")], "host string, path string, verdict string")
    got = urlrules.judge(pages, rules).select("page.page_id", "page.url", "judged.*").collect()
    assert len(got) == len(URLS) * 3
    assert all(tuple(r)[2:] == judged(r["url"]) for r in got)
    assert urlrules.judge(pages.limit(0), rules).count() == 0
    assert {tuple(r) for r in urlrules.judge(pages, rules.limit(0)).select("judged.rule", "judged.verdict").collect()} == {(None, "allow")}


def test_bloom_filter_lets_all_listed_through(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".org/p")).alias("key"))
    bloom = urlrules.bloom_filter(listed, 93)
    assert urlrules.let_through(listed, bloom, 93).count() == 3000
    assert urlrules.let_through(spark.range(3000).select(F.concat(F.lit("other"), "id").alias("key")), bloom, 93).count() < 150
