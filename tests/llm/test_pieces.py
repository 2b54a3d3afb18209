"""SentencePiece encoding against the library: ids, the source of every piece, decoded texts."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor, sentencepiece_model_pb2

from tidemark.llm import pieces
from tidemark.llm.pieces import Encoder, default_model

ODD = [
    "", None, " ", "  ", "a", " a", "a ", "  a  b  ", "▁", "▁a ▁▁ b", "a▁b", " ▁ ", "\n", "\t\nx", "\x00", "\x01", "😀", "a😀b 日本語 テスト", "<s></s><unk><0x0A>", "é" * 300, "x" * 500, "ab" * 200,
    " " * 100, "é ́", "ﬁx ① ｱﾊﾟｰﾄ", "¨ x", "x ¨", "　　全角　", "​﻿z­", "中" * 70, "word " * 3000, "가각가",
]


def model_file(tmp_path_factory, rule: str | None, **rules) -> str:
    """The public vocabulary with other rules of normalisation."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    if rule:
        own = sentencepiece_model_pb2.ModelProto()
        own.ParseFromString(SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        proto.normalizer_spec.CopyFrom(own.normalizer_spec)
    for name, value in rules.items():
        setattr(proto.normalizer_spec, name, value)
    path = tmp_path_factory.mktemp("model") / "m.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


RULES = {
    "own": (None, {}), "nfkc": ("nmt_nfkc", {}), "folded": ("nfkc_cf", {"remove_extra_whitespaces": False}),
    "bare": ("nmt_nfkc", {"add_dummy_prefix": False}), "squeezed": (None, {"remove_extra_whitespaces": True}), "kept": (None, {"add_dummy_prefix": False}),
}


@pytest.fixture(scope="module", params=sorted(RULES))
def encoder(request, tmp_path_factory):
    rule, rules = RULES[request.param]
    return Encoder(model_file(tmp_path_factory, rule, **rules))


def same(enc: Encoder, texts: list) -> None:
    ids, begins, ends, at = enc.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        own, source = slice(at[i], at[i + 1]), (text or "").encode()
        assert ids[own].tolist() == enc.library.encode(text or "", add_eos=True), text
        surfaces = [source[b:e].decode() for b, e in zip(begins[own], ends[own], strict=True)]
        assert surfaces[:-1] == [p.surface for p in enc.library.encode_as_proto(text or "").pieces], text
        assert surfaces[-1] == "" and ends[own][-1] == len(source)


def test_odd_texts(encoder):
    same(encoder, ODD)
    encoder.forget()
    same(encoder, ODD[::-1])


piece = st.sampled_from(["a", "b", "the", " ", "  ", "▁", "é", "é", "ﬁ", "①", "ﾊﾟ", "¨", "😀", "\n", "中文", "　", "\x01", "ing"])


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(piece, max_size=30).map("".join), st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40)), min_size=1, max_size=5))
def test_random_texts(encoder, texts):
    same(encoder, texts)


def test_long_units_as_short_ones(encoder):
    """A unit is merged by rounds or by a heap; both give the same."""
    text = "".join("internationalisation"[i % 20 : i % 20 + 3] for i in range(pieces.MANY))
    same(encoder, [text, text[: pieces.MANY - 1], text * 20])


def test_without_blanks_a_text_is_covered():
    enc = pieces.encoder(default_model())
    text = "Tout est là 😀\n"
    _, begins, ends, _ = enc.encode(pa.array([text]))
    assert b"".join(text.encode()[b:e] for b, e in zip(begins, ends, strict=True)).decode() == text


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_UNITS", 3)
    enc = Encoder(default_model())
    for _ in range(2):
        same(enc, ["one two three", "four five", "one two six"])
    assert len(enc.known) <= 6


def test_portions():
    texts = ["a" * 10, None, "", "b" * 25, "c", "d" * 9, "e" * 9, "f"]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts)})
    got = [p.column(0).to_pylist() for p in pieces.portions(iter([batch.slice(0, 3), batch.slice(3, 5)]), 0, 20)]
    assert [t for p in got for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 20 for p in got)


def test_other_models_are_refused(tmp_path):
    proto = sentencepiece_model_pb2.ModelProto()
    with open(default_model(), "rb") as f:
        proto.ParseFromString(f.read())
    for change in (lambda p: setattr(p.trainer_spec, "model_type", 1), lambda p: setattr(p.trainer_spec, "byte_fallback", False), lambda p: setattr(p.pieces[500], "type", 4), lambda p: setattr(p.pieces[500], "piece", "a▁b")):
        odd = sentencepiece_model_pb2.ModelProto()
        odd.CopyFrom(proto)
        change(odd)
        (tmp_path / "m").write_bytes(odd.SerializeToString())
        with pytest.raises(ValueError):
            Encoder(str(tmp_path / "m"))


def test_rows(spark):
    """Nulls, repeated rows, clashing and dotted columns; spans and decoded texts."""
    rows = [(i if i % 5 else None, t, "x", i) for i, t in enumerate(ODD)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `doc.id` int")
    library = SentencePieceProcessor(model_file=default_model())
    got = pieces.encoded(docs).select("doc.*", F.col("ids").alias("found"), "begins", "ends", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["found"] == library.encode(r["text"] or "", add_eos=True) and r["decoded"] == library.decode(r["found"]) and r["ids"] == "x"
        assert len(r["begins"]) == len(r["ends"]) == len(r["found"]) and r["ends"][-1] == len((r["text"] or "").encode())
    assert pieces.encoded(docs.limit(0)).collect() == []


def test_query(spark, tmp_path):
    spark.createDataFrame([*enumerate(ODD), (None, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    library = SentencePieceProcessor(model_file=default_model())
    got = {r["doc_id"]: r for r in pieces.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(ODD):
        ids = library.encode(t or "", add_eos=True)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[i]) == (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
