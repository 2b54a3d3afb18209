"""SentencePiece encoding and decoding with source offsets (operator 11).

Texts are encoded as the library encodes them, and every piece is given with the
bytes of the original text that it stands for.

1. Normalisation.  The model's compiled character map, a double array, is
   followed from every character of a batch at once; of overlapping keys the
   first and longest counts.  Each normalised byte keeps the place of the source
   character it comes from (``Aligned``), through the rules on white space too.
2. Segmentation.  No piece of the model goes on after white space, so texts are
   cut before it and distinct units are segmented once: pairs of symbols are
   merged, best score first, ties from the left, for all new units in a round.
   Characters without a piece become their bytes.
3. Projection.  Widths of pieces give places in the normalised text, and these
   the source bytes (``begins``, ``ends``).

Decoding is the library's own.

Models: BPE with byte fallback, white space as a prefix, no pieces of the user's;
any other is refused when it is loaded.

Defined cases: null text is empty and gives the end id alone; repeated rows are
encoded each for itself; a whole text is one value in one task, whatever its
length; texts are valid UTF-8; an empty table stays one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gathered, in_batches, table, whole_row

MODEL = "piece_bpe_32k.model"
#: Units whose pieces a worker keeps; symbols of a unit beyond which its pairs wait in a heap; bytes of texts encoded at once.
CACHE_UNITS, MANY, AT_ONCE = 500_000, 64, 2 << 20
# Kinds of models and of pieces in the model file, the mark of white space.
BPE, NORMAL, CONTROL, UNKNOWN, BYTE = 2, 1, 3, 2, 6
MARK = "▁"
BLANK = 0x20


@dataclass
class Aligned:
    """Texts of a batch in a row.

    ``data`` are their bytes and ``at`` where each text starts and ends in them; ``source`` is where in the source what
    a byte comes from starts and ``width`` how long it is; ``stop`` is where each text ends in the source.
    """

    data: np.ndarray
    at: np.ndarray
    source: np.ndarray
    width: np.ndarray
    stop: np.ndarray

    def kept(self, keep: np.ndarray) -> Aligned:
        before = np.concatenate([[0], np.cumsum(keep)])
        return Aligned(self.data[keep], before[self.at], self.source[keep], self.width[keep], self.stop)

    def after_blanks(self, start: np.ndarray) -> np.ndarray:
        """``start`` of each text, or where the characters that became one blank each end there."""
        start = start.copy()
        for d in np.flatnonzero(np.append(self.data, 0)[self.at[:-1]] == BLANK).tolist():
            i, end = int(self.at[d]), int(self.at[d + 1])
            while i < end and self.data[i] == BLANK and self.source[i] == start[d] and (i + 1 == end or self.source[i + 1] != start[d]):
                start[d] += self.width[i]
                i += 1
        return start


class CharacterMap:
    """The compiled map of a model: a trie over bytes as a double array, and the texts that its keys become."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.cells = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.texts = blob[4 + size :]

    @staticmethod
    def _jump(cell: np.ndarray) -> np.ndarray:
        return (cell >> 10) << ((cell >> 6) & 8)

    def longest(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the longest key at each place (0: none) and where its text stands; ``stop`` is the end of a place's text."""
        length, value = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        at = np.flatnonzero(data & 0xC0 != 0x80)
        node, depth = np.full(len(at), self._jump(self.cells[0])), 0
        while (inside := at + depth < stop[at]).any():
            at, node = at[inside], node[inside]
            byte = data[at + depth]
            node = node ^ byte
            cell = self.cells[np.minimum(node, len(self.cells) - 1)]
            on = (node < len(self.cells)) & (cell & 0x800000FF == byte)
            at, node, cell, depth = at[on], node[on], cell[on], depth + 1
            node = node ^ self._jump(cell)
            ends = cell & 0x100 != 0
            length[at[ends]], value[at[ends]] = depth, self.cells[node[ends]] & 0x7FFFFFFF
        return length, value

    def apply(self, x: Aligned) -> Aligned:
        length, value = self.longest(x.data, np.repeat(x.at[1:], np.diff(x.at)))
        chosen, free = [], 0
        for i in np.flatnonzero(length).tolist():
            if i >= free:
                chosen.append(i)
                free = i + int(length[i])
        if not chosen:
            return x
        made = [self.texts[v : self.texts.index(b"\0", v)] for v in value[chosen].tolist()]
        keys, size = np.array(chosen), np.array([len(t) for t in made])
        # each key's first byte becomes its text, its other bytes go
        times = np.ones(len(x.data), np.int64)
        covered = np.repeat(keys - (np.cumsum(length[keys]) - length[keys]), length[keys]) + np.arange(length[keys].sum())
        times[covered] = 0
        times[keys] = size
        data = np.repeat(x.data, times)
        before = np.concatenate([[0], np.cumsum(times)])
        into = np.repeat(before[keys] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        data[into] = np.frombuffer(b"".join(made), np.uint8)
        width = np.repeat(x.width, times)
        width[into] = np.repeat(length[keys], size)
        return Aligned(data, before[x.at], np.repeat(x.source, times), width, x.stop)


class Encoder:
    """Batches of texts to ids and source spans."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(raw)
        self._load(proto)
        self.library = SentencePieceProcessor(model_proto=raw)

    def _load(self, proto) -> None:
        self.rules, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        self.map = CharacterMap(self.rules.precompiled_charsmap) if self.rules.precompiled_charsmap else None
        self.id_of = {p.piece.replace(MARK, " "): i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        joined = [p for p in self.id_of if " " in p.lstrip(" ")]
        single = {c for p in self.id_of for c in p}
        if proto.trainer_spec.model_type != BPE or not proto.trainer_spec.byte_fallback or kinds - {NORMAL, CONTROL, UNKNOWN, BYTE} or joined \
                or proto.trainer_spec.treat_whitespace_as_suffix or not self.rules.escape_whitespaces or not single <= self.id_of.keys():
            raise ValueError("only BPE models with byte fallback, pieces of known characters and white space before words are read")
        self.size = len(proto.pieces)
        self.end_id = next(i for i, p in enumerate(proto.pieces) if p.piece == (proto.trainer_spec.eos_piece or "</s>"))
        of_byte = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_ids = np.array([of_byte[f"<0x{b:02X}>"] for b in range(256)], np.int64)
        _, place = np.unique([-p.score for p in proto.pieces], return_inverse=True)  # equal scores are equal in place
        pairs = [(self.id_of[p[:k]] * self.size + self.id_of[p[k:]], i) for p, i in self.id_of.items() for k in range(1, len(p)) if p[:k] in self.id_of and p[k:] in self.id_of]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pairs, self.merged = np.append(pairs[:, 0], np.iinfo(np.int64).max), np.append(pairs[:, 1], -1)
        self.place = np.append(place[pairs[:, 1]], len(proto.pieces))
        self.forget()

    def forget(self) -> None:
        """A ``known`` unit has its ids and widths from ``first`` to ``first + n``."""
        self.known = pa.array([], pa.binary())
        self.ids, self.widths = np.empty(0, np.int32), np.empty(0, np.int32)
        self.first = self.n = np.empty(0, np.int64)

    # --- normalisation ---

    def normalised(self, texts: pa.Array) -> Aligned:
        """Normalised texts with a blank for each mark of white space."""
        texts = texts.cast(pa.binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        x = Aligned(data, at, np.arange(len(data), dtype=np.int32), np.ones(len(data), np.int32), at[1:])
        if self.map:
            x = self.map.apply(x)
        squeeze, start = self.rules.remove_extra_whitespaces, at[:-1]
        if squeeze:
            start = x.after_blanks(start)
            blank = x.data == BLANK
            after = np.concatenate([[True], blank[:-1]]) if len(blank) else blank
            after[x.at[:-1][x.at[:-1] < len(blank)]] = True
            x = x.kept(~(blank & after))
        mark = np.frombuffer(MARK.encode(), np.uint8)
        if len(found := np.flatnonzero((x.data[:-2] == mark[0]) & (x.data[1:-1] == mark[1]) & (x.data[2:] == mark[2]))):
            keep = np.ones(len(x.data), bool)
            keep[found + 1] = keep[found + 2] = False
            x.data = x.data.copy()
            x.data[found] = BLANK
            x = x.kept(keep)
        if squeeze:
            ink = np.flatnonzero(x.data != BLANK)
            last = np.searchsorted(ink, x.at[1:]) - 1
            until = np.maximum(x.at[:-1], np.append(ink, -1)[last] + 1)
            cut = until < x.at[1:]
            x.stop = np.where(cut, x.source[np.minimum(until, len(x.data) - 1)] if len(x.data) else 0, x.stop)
            x = x.kept(np.arange(len(x.data)) < np.repeat(until, np.diff(x.at)))
        if self.rules.add_dummy_prefix:
            own = np.diff(x.at) > 0 if squeeze else np.diff(at) > 0
            where = x.at[:-1][own]
            moved = x.at + np.concatenate([[0], np.cumsum(own)])
            x = Aligned(np.insert(x.data, where, BLANK), moved, np.insert(x.source, where, start[own]), np.insert(x.width, where, 1), x.stop)
        return x

    # --- segmentation ---

    def segment(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and widths in bytes of the pieces of all units, and how many each has."""
        text = b"".join(units.to_pylist()).decode()
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        unit = np.repeat(np.arange(len(units)), pc.binary_length(units).to_numpy())[np.cumsum(width) - width]
        distinct, which = np.unique(chars, return_inverse=True)
        symbol = np.array([self.id_of.get(chr(c), -1 - c) for c in distinct.tolist()], np.int64)[which]  # negative: a character without a piece
        many = np.bincount(unit, minlength=len(units))[unit] > MANY
        done = [self._merged_by_heap(symbol[many], width[many], unit[many])]
        symbol, width, unit = symbol[~many], width[~many], unit[~many]
        while symbol.size:
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            key = np.where((symbol[:-1] >= 0) & (symbol[1:] >= 0) & (unit[1:] == unit[:-1]), symbol[:-1] * self.size + symbol[1:], -1)
            k = np.searchsorted(self.pairs, key)
            k[self.pairs[k] != key] = len(self.pairs) - 1
            order = np.append(self.place[k], self.size) << 32 | np.arange(len(symbol))
            best = np.minimum.reduceat(order, first)
            at = best[best >> 32 < self.size] & 0xFFFFFFFF
            still = np.repeat(best >> 32 < self.size, np.diff(np.append(first, len(symbol))))
            done.append((symbol[~still], width[~still], unit[~still]))
            symbol[at] = self.merged[k[at]]
            width[at] += width[at + 1]
            still[at + 1] = False
            symbol, width, unit = symbol[still], width[still], unit[still]
        symbol, width, unit = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(unit, kind="stable")
        return self._bytes_for_unknown(symbol[order], width[order], unit[order], len(units))

    def _merged_by_heap(self, symbol: np.ndarray, width: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As the rounds, for units so long that a round for each merge would be slow."""
        s, n = symbol.tolist(), len(symbol)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        last = np.append(unit[1:] != unit[:-1], True).tolist() if n else []
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if 0 <= i and not last[i] and s[i] >= 0 and s[after[i]] >= 0:
                key = s[i] * self.size + s[after[i]]
                k = int(np.searchsorted(self.pairs, key))
                if self.pairs[k] == key:
                    heapq.heappush(heap, (int(self.place[k]), i, key, int(self.merged[k])))

        for i in range(n):
            offer(i)
        gone = np.zeros(n, bool)
        while heap:
            _, i, key, made = heapq.heappop(heap)
            if gone[i] or last[i] or s[i] < 0 or s[i] * self.size + s[after[i]] != key:
                continue
            j = after[i]
            s[i], after[i], last[i], gone[j] = made, after[j], last[j], True
            width[i] += width[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0 and not last[before[i]]:
                offer(before[i])
        return np.array(s, np.int64)[~gone], width[~gone], unit[~gone]

    def _bytes_for_unknown(self, symbol: np.ndarray, width: np.ndarray, unit: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes; the last of these has the character's width."""
        if len(odd := np.flatnonzero(symbol < 0)):
            times = np.ones(len(symbol), np.int64)
            times[odd] = width[odd]
            found = np.frombuffer("".join(chr(-1 - c) for c in symbol[odd].tolist()).encode(), np.uint8)
            ends = np.cumsum(times) - 1
            into = np.repeat(ends[odd] + 1 - np.cumsum(times[odd]), times[odd]) + np.arange(len(found))
            wide = np.zeros(int(times.sum()), np.int64)
            wide[ends] = width
            symbol, width, unit = np.repeat(symbol, times), wide, np.repeat(unit, times)
            symbol[into] = self.byte_ids[found]
        return symbol.astype(np.int32), width.astype(np.int32), np.bincount(unit, minlength=n)

    def learn(self, units: pa.Array) -> None:
        ids, widths, n = self.segment(units)
        self.known = pa.concat_arrays([self.known, units])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
        self.n, self.ids, self.widths = np.concatenate([self.n, n]), np.concatenate([self.ids, ids]), np.concatenate([self.widths, widths])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, begins and ends of the pieces of all texts, in bytes of their text, with an end id; and where each text's pieces start."""
        x = self.normalised(texts)
        blank = x.data == BLANK
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        head[x.at[:-1][np.diff(x.at) > 0]] = True
        start = np.flatnonzero(head)
        ends = np.append(start, len(x.data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x.data))]).dictionary_encode()
        names = coded.dictionary
        if len(self.known) + len(names) > CACHE_UNITS:
            self.forget()
        known = pc.index_in(names, value_set=self.known).fill_null(-1).to_numpy().copy()
        if len(late := np.flatnonzero(known < 0)):
            known[late] = len(self.known) + np.arange(len(late))
            self.learn(names.take(pa.array(late)))
        which = known[coded.indices.to_numpy()]
        n = self.n[which]
        place = np.arange(int(n.sum())) + np.repeat(self.first[which] - (np.cumsum(n) - n), n)
        ids, width = self.ids[place], self.widths[place]
        until = np.cumsum(width, dtype=np.int64)
        # the pieces of a text, and with the end id
        pieces = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(start, x.at)]
        source = np.append(x.source, 0)
        begins, ends = source[until - width], source[until]
        ends[width == 0] = begins[width == 0]
        some = np.flatnonzero(np.diff(pieces))
        ends[pieces[some + 1] - 1] = x.stop[some]
        offsets = pc.binary_length(texts.cast(pa.binary())).fill_null(0).to_numpy().astype(np.int64)
        base = np.cumsum(offsets) - offsets
        shift = np.repeat(base, np.diff(pieces))
        close = pieces[1:]
        ids = np.insert(ids, close, self.end_id)
        begins, ends = (np.insert(v - shift, close, offsets).astype(np.int32) for v in (begins, ends))
        return ids, begins, ends, pieces + np.arange(len(pieces))


def portions(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Batches whose texts have about ``size`` bytes; a longer text is one by itself."""
    for batch in gathered(batches, size):
        until = np.cumsum(pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(batch):
            before = int(until[start - 1]) if start else 0
            end = max(start + 1, int(np.searchsorted(until, before + size, "right")))
            yield batch.slice(start, end - start)
            start = end


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


COLUMNS = {"ids": "array<int>", "begins": "array<int>", "ends": "array<int>", "decoded": "string"}


def encoded(docs: DataFrame, model: str | None = None, keep: list[str] | None = None, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``, default all) and ``columns`` of each row of ``docs``.

    ``ids`` ends with the end id; ``begins`` and ``ends`` are the source bytes of each id; ``decoded`` is what the library
    makes of the ids.
    """
    model, keep = model or default_model(), keep or docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in portions(batches, 1, AT_ONCE):
            ids, begins, ends, at = enc.encode(batch.column(1))
            lists = lambda v: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32()))  # noqa: B023, E731
            make = {
                "ids": lambda: lists(ids), "begins": lambda: lists(begins), "ends": lambda: lists(ends),  # noqa: B023
                "decoded": lambda: pa.array([enc.library.decode(x.tolist()) for x in np.split(ids, at[1:-1])][: len(batch)], pa.string()),  # noqa: B023
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *(make[c]() for c in columns)], ["doc", *columns])

    kept = T.StructField("doc", T.StructType([docs.schema[c] for c in keep]))
    rows = in_batches(docs).select(whole_row(docs.select(*(f"`{c.replace('`', '``')}`" for c in keep))).alias("doc"), "text")
    return rows.mapInArrow(run, T.StructType([kept, *T._parse_datatype_string(", ".join(f"{c} {COLUMNS[c]}" for c in columns)).fields]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], columns=("ids", "decoded"))
    digest = lambda c: F.sha2(c, 256)
    return rows.select("doc.doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", " ")).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))
