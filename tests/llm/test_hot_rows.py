"""Rows that repeat an id or have none, and benchmarks of many groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, pseudolikelihood, quality, tokenstore


def totals(rows):
    per = rows.groupBy("doc.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    return {r["source"]: r for r in per}


def test_rows_without_id_come_near_their_target(spark):
    """2,000 rows of a source have no id, and as many others are all the same; each has a draw of its own."""
    words = "w " * 5
    rows = [(None, f"{words}{i % 1900}", "a") for i in range(2000)] + [(7, words, "b")] * 2000 + [(i, words, "c") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    planned = mixing.planned(docs)
    for r in totals(planned).values():
        assert abs(r["taken"] - r["target"]) < 0.05 * r["target"] and r["most"] <= 2, r
    again = mixing.planned(docs.repartition(3))  # reruns agree, however rows lie
    counted = lambda df: {tuple(r[:3]): r["n"] for r in df.groupBy("doc.doc_id", "doc.text", "copies").agg(F.count("*").alias("n")).collect()}
    assert counted(planned) == counted(again)


def test_equal_rows_are_numbered(spark, monkeypatch):
    rows = [(1, "x", "s", "k")] * 500 + [(1, "x", "t", "k")] * 3 + [(1, None, "s", "k"), (1, "", "s", "k"), (None, "x", None, "k"), (None, "x", None, "k"), (2, "x", "s", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, digest string").repartition(5)
    for most in (mixing.MAX_BROADCAST_SOURCES, 1):
        monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", most)
        got: dict = {}
        for r in mixing.numbered(docs).select("doc.*", "again").collect():
            got.setdefault((r["doc_id"], r["text"] or "", r["source"]), []).append(r["again"])
        assert {k: sorted(v) for k, v in got.items()} == {(1, "x", "s"): [*range(1, 501)], (1, "x", "t"): [1, 2, 3], (1, "", "s"): [1, 2], (None, "x", None): [1, 2], (2, "x", "s"): [1]}


def test_one_labelled_id_with_many_rows(spark):
    """The driver gets one row of it, the same one in every run."""
    docs = spark.createDataFrame([(1, f"text {i} number {i}") for i in range(3000)] + [(2, "a b"), (5, None), (9, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (5, 1), (77, 1), (None, 1)], "doc_id long, quality int")
    usable = [i for i in (1, 2, 5) if not docs.where(f"doc_id = {i}").where(quality.held_out(F.col("doc_id"))).count()]
    x, y = quality.labelled(docs, labels, "quality", 100)
    assert len(x) == len(y) == len(usable) and dict(zip(usable, y, strict=True)) == {i: {1: 1.0, 2: 0.0, 5: 1.0}[i] for i in usable}
    again, _ = quality.labelled(docs.repartition(5), labels, "quality", 100)
    assert (x == again).all()


def python_nodes(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("MapInArrow")


def test_more_groups_are_no_longer_plan(spark, monkeypatch):
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(30))) for k in range(12)]
    bench = spark.createDataFrame([*items, ("again", items[0][1]), (None, "short one")], "item_id string, text string")
    texts = [items[0][1], f"before {items[1][1]} after", f"{items[2][1]} {items[3][1]}", "w4x0 " + items[4][1][5:], "a short one here", "nothing", "", None, items[0][1]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")

    def told(size):
        monkeypatch.setattr(decontaminate, "MAX_GROUP_BYTES", size)
        out = decontaminate.judge(docs, bench, keep=["doc_id", "digest"])
        return out, sorted((r["doc"]["doc_id"], r["n_words"], r["n_hit"], r["spans"], r["items"]) for r in out.collect())

    whole, want = told(1 << 20)
    few, some = told(1500)
    many, every = told(200)
    assert want == some == every and sum(n > 0 for _, _, n, _, _ in want) == 6 and want[2][2:4] == (60, [0, 60])
    assert python_nodes(few) == python_nodes(many) <= 2 and python_nodes(whole) == 1


def test_equal_rows_are_spread_over_parts(spark, tmp_path):
    """Two thirds of the rows have no id and one text: no part has most of them, and ids and order are as ever."""
    rows = [(None, "the same words")] * 4000 + [(i, f"text {i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenstore.write_tokens(docs, str(tmp_path / "tokens"), tokenstore.default_tokenizer())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = tokenstore.read_tokens(spark, str(tmp_path / "tokens"))
    held = {r["part"]: r["count"] for r in got.groupBy("part").count().collect()}
    assert sum(held.values()) == 6000 and max(held.values()) < 2500, held
    listed = got.orderBy("start").collect()
    assert [r["doc_id"] for r in listed] == [None] * 4000 + [*range(2000)]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(listed, listed[1:]))
    assert len({r["ids_crc32"] for r in listed[:4000]}) == 1


def test_equal_rows_are_dealt_to_all_lots(spark):
    rows = [(None, "the same words")] * 3000 + [(i, f"text {i}") for i in range(1000)] + [(5, "text 5"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lots = {}
    for n in (3, 7):
        apart = pseudolikelihood.told_apart(docs.repartition(n))
        assert apart.where("copy IS NULL").count() == 1002 and apart.count() == len(rows)
        lots[n] = {(r["lot"], r["text"]): r["count"] for r in pseudolikelihood.dealt(apart, 8).groupBy("lot", "text").count().collect()}
    assert lots[3] == lots[7]
    assert all(300 < lots[3][lot, "the same words"] < 450 for lot in range(8))
