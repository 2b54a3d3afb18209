r"""Chat formatting (operator 8, DataFrame functions only).

The turns of a conversation are collected as structs, sorted, adjacent turns
of one role are merged into a block by array functions, and the blocks are
concatenated:

    <s>[INST]role[/INST]text</s><s>[INST]role[/INST]text<sep>text</s>

``<sep>`` stands between merged turns, so merging can be undone.  Inside roles
and texts a backslash is doubled and a control string gets a backslash after
its first character; ``\x`` reads back as ``x``.  No control string starts
inside another, so after escaping none is left and reading back is exact.

``loss_spans`` lists (turn, start, length), one for each turn whose role is
``assistant``: the number of the turn, from 0, and code points, from 1, in the
stretch of text between what ends the turn before and what ends this one.  A
reader cuts the text once and needs no sums; ``loss_ranges`` gives the places in
the whole text.

Defined cases: null text is empty text, null role the empty role; turns sort
by turn (null first), then role, then text, so repeated rows stay and ties are
deterministic; a null conv_id is a conversation of its own; an empty table
gives no rows.  A formatted conversation is one value and so lies in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BEGIN, ROLE, TEXT, SEP, END = "<s>", "[INST]", "[/INST]", "<sep>", "</s>"
CONTROL = r"</?s>|<sep>|\[/?INST\]"
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(?=(?:/?s>|sep>|/?INST\]))", r"$1\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: one row per conversation."""
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    chats = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # where a block of one role begins and ends is seen from a turn's neighbours, so work is linear in the turns
    def stretch(t: Column, i: Column) -> Column:
        begins = (i == 0) | (F.get("turns", i - 1)["role"] != t["role"])
        ends = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != t["role"])
        head = F.when(begins, F.concat(F.lit(BEGIN + ROLE), escape(t["role"]), F.lit(TEXT))).otherwise(F.lit(""))
        tail = F.when(ends, F.lit(END)).otherwise(F.lit(SEP))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), tail.alias("tail"), (t["role"] == loss_role).alias("loss"), i.alias("turn"))

    parts = chats.select("conv_id", F.transform("turns", stretch).alias("parts"))
    spans = F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["turn"], (F.char_length(p["head"]) + 1).alias("start"), F.char_length(p["body"]).alias("length")))
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"), spans.alias("loss_spans"))


def _quoted(s: str) -> str:
    return rf"\Q{s}\E"


def stretches(formatted: Column) -> Column:
    """The text cut after each turn, without what ends a turn."""
    return F.split(formatted, f"{_quoted(END)}|{_quoted(SEP)}", -1)


def loss_ranges(chats: DataFrame) -> DataFrame:
    """conv_id, start, length of each span in the whole text, for readers that count from its beginning."""
    pieces = chats.select("conv_id", "loss_spans", F.posexplode(F.split("formatted", f"(?<={_quoted(END)})|(?<={_quoted(SEP)})", -1)).alias("turn", "piece"))
    before = F.sum(F.char_length("piece").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn")) - F.char_length("piece")
    own = F.explode(F.filter("loss_spans", lambda s: s["turn"] == F.col("turn")))
    return pieces.withColumn("before", before).select("conv_id", "before", own.alias("s")).select("conv_id", (F.col("before") + F.col("s.start")).alias("start"), F.col("s.length").cast("long").alias("length"))


def read_chat(chats: DataFrame) -> DataFrame:
    """``turns`` (role, text) and ``loss_text`` read back from formatted text and mask."""
    blocks = F.filter(F.split("formatted", _quoted(END), -1), lambda b: b != "")
    role = lambda b: unescape(F.substring_index(F.substr(b, F.lit(len(BEGIN + ROLE) + 1)), TEXT, 1))
    body = lambda b: F.substr(b, F.instr(b, TEXT) + len(TEXT))
    read = lambda b: F.transform(F.array(role(b)), lambda r: F.transform(F.split(body(b), _quoted(SEP), -1), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))
    turns = F.flatten(F.flatten(F.transform(blocks, read)))
    # bound as a variable, the stretches are cut once and not for each span
    loss = F.transform(F.array(stretches(F.col("formatted"))), lambda cut: F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr(F.get(cut, s["turn"]), s["start"], s["length"]))), ""))
    return chats.select("*", turns.alias("turns"), loss[0].alias("loss_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    back = read_chat(format_chat(rows.unionByName(probe)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS merged,
    length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '</?s>|<sep>|\[/?INST\]')) AS role_chars,
    length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?s>|<sep>|\[/?INST\]')) AS text_chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN merged THEN 5 ELSE role_chars + 20 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
