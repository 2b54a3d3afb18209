"""Token ids as a grammar-compressed binary dataset (operator 1).

Documents are range-partitioned by doc_id, encoded with a public tokenizer and
cut into shards of about ``shard_tokens`` ids.  Each shard is compressed by
Re-Pair: in rounds, the most frequent adjacent pairs of symbols are replaced by
new symbols, until no pair is frequent or the symbols no longer fit 16 bits.
Pairs never span two documents, so a document is a run of symbols, and with the
expansion length of every symbol a reader finds any token of it without
decoding the rest (``read_ids``).

The file format is a Parquet dataset, one row per shard: ``part`` and ``shard``
give the order, ``docs`` the doc_ids, and binary columns hold little-endian
arrays: ``symbols`` (u2), ``doc_ends`` (u4, symbols up to the end of each
document), ``n_ids`` (u4, ids of each document), ``rules`` (pairs of u2; rule r
is symbol ``vocabulary`` + r) and ``expansions`` (u4, length of each rule).
Spark's committer writes it to any store and redoes the files of lost tasks.

Encoding looks up units of text in a bounded cache: the tokenizer's own
pre-tokenizer splits before every blank but one that stands between white space
and more of it or the end, so units can be encoded apart; texts with such a
blank or a special token's string are encoded whole.

Defined cases: null text is empty and yields the end id alone; doc_ids sort
ascending, null first; rows of one doc_id follow in the order of their text's
hash, and equal rows may lie in several parts; an empty table gives an empty
dataset.
"""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, in_batches, shared_dir, table

END_ID, SHARD_TOKENS, PAIRS_A_ROUND, LEAST_COUNT = 0, 1 << 19, 2048, 8
#: Units whose ids a worker keeps; pieces encoded at once; bytes of texts encoded at once; units whose ids are gathered at once.
CACHE_UNITS, LINES, BATCH_TEXT, GATHERED = 1_500_000, 256, 16 << 20, 1 << 17
TOKENIZER = "byte_bpe_50k.json"
# The byte-level tokenizer's own rule of splitting, a blank before a piece aside.
BYTE_LEVEL = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
KINDS = (r"\p{L}+", r"\p{N}+", r"[^\p{L}\p{N}\n]+")
#: Characters of units that are cut here: neither white space nor the apostrophe, which starts pieces of its own, nor
#: anything on whose kind two versions of Unicode might differ.
CHAR = r"[!-&(-~\x{a1}-\x{24f}]"
#: White space for Arrow's patterns, whatever one of the libraries takes for it.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FILE_SCHEMA = "part int, shard int, docs array<long>, n_tokens long, vocabulary int, symbols binary, doc_ends binary, n_ids binary, rules binary, expansions binary"


class Encoder:
    """Texts to ids, many at a time.

    A batch of texts is split before each blank by Arrow, and its distinct units are looked up among those ``known``;
    what occurrences cost is a gather.  Unknown units are cut as the tokenizer's own pre-tokenizer would cut them, and
    the pieces are encoded by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError(f"{path}: {self.size} ids do not fit the 16 bits of the file format")
        #: Only a byte-level tokenizer splits at blanks in this way; any other one gets whole texts.
        self.splits = self.tokenizer.normalizer is None and str(self.tokenizer.pre_tokenizer) == BYTE_LEVEL
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = "|".join([f"{SPACE} (?:{SPACE}|$)", *special])
        self.lines = Tokenizer.from_file(path)  # every line is one piece
        self.lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)  # a character for each byte
        self.line = self.whole(["\n"])[0]
        self.forget()

    def forget(self) -> None:
        """A ``known`` unit has its ids in ``pool`` from ``at`` to ``at + n``; one that has no blank before it starts with one here."""
        self.known = pa.array([], pa.string())
        self.pool = np.empty(0, "<u2")
        self.at = self.n = np.empty(0, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and how many each has; no piece holds a line feed."""
        lots = pa.ListArray.from_arrays(pa.array([*range(0, len(pieces), LINES), len(pieces)], pa.int32()), pieces)
        held, count = [np.empty(0, "<u2")], [np.empty(0, np.int64)]
        for joined in pc.binary_join(lots, "\n").to_pylist():
            ids = np.array(self.lines.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u2")
            stop = np.flatnonzero(np.frombuffer(joined.encode() + b"\n", np.uint8) == 10)
            stop -= np.arange(len(stop))  # bytes up to the end of each piece
            held.append(ids)
            count.append(np.diff(np.searchsorted(np.cumsum(self.bytes_of[ids]), stop) + 1, prepend=0))
        return np.concatenate(held), np.concatenate(count)

    def ids_of(self, place: np.ndarray) -> np.ndarray:
        """The ids of known units in a row."""
        out = [np.empty(0, "<u2")]
        for i in range(0, len(place), GATHERED):
            n, at = self.n[place[i : i + GATHERED]], self.at[place[i : i + GATHERED]]
            out.append(self.pool[np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)])
        return np.concatenate(out)

    def add(self, units: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, units])
        self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.pool = np.concatenate([self.pool, ids])

    def learn(self, units: pa.Array) -> None:
        """Add units that are not known."""
        plain = pc.match_substring_regex(units, f"^{CHAR}+(?:\n{CHAR}+)*\n?$")
        single = pc.and_(plain, pc.match_substring_regex(units, f"^(?:{'|'.join(KINDS)})$"))
        made = pc.and_not(plain, single)
        odd = units.filter(pc.invert(pc.or_(single, made))).to_pylist()
        found = self.whole([u[1:] if u[:1] == " " else " " + u for u in odd])
        self.add(pa.array(odd, pa.string()), np.concatenate([np.empty(0, "<u2"), *found]), np.array([len(x) for x in found], np.int64))
        # the others are cut into pieces, which are units themselves
        made = units.filter(made)
        cut = pc.split_pattern(pc.utf8_rtrim(pc.replace_substring_regex(made, f"({'|'.join(KINDS)}|\n)", "\\1\x00"), "\x00"), "\x00")
        ends, parts = cut.offsets.to_numpy(), cut.flatten()
        first = np.zeros(len(parts), bool)
        first[ends[:-1]] = True
        parts = pc.if_else(pa.array(first), parts, pc.binary_join_element_wise("", parts, " ")).dictionary_encode()
        names = parts.dictionary
        place = pc.index_in(names, value_set=self.known)
        fresh = pc.unique(pa.concat_arrays([units.filter(single), names.filter(place.is_null())]))
        feed = pc.equal(fresh, " \n")
        texts = pc.if_else(pc.starts_with(fresh, " "), pc.utf8_slice_codeunits(fresh, 1), pc.binary_join_element_wise("", fresh, " "))
        new = len(self.known)
        if pc.any(feed).as_py():
            self.add(fresh.filter(feed), self.line, np.array([len(self.line)]))
        fresh, texts = fresh.filter(pc.invert(feed)), texts.filter(pc.invert(feed))
        self.add(fresh, *self.encode_pieces(texts))
        if len(made):
            place = place.fill_null(-1).to_numpy().copy()
            late = np.flatnonzero(place < 0)
            place[late] = new + pc.index_in(names.take(pa.array(late)), value_set=self.known.slice(new)).to_numpy()
            place = place[parts.indices.to_numpy()]
            self.add(made, self.ids_of(place), np.add.reduceat(self.n[place], ends[:-1]))

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        texts = texts.cast(pa.string()).fill_null("")
        apart = pc.match_substring_regex(texts, self.apart).to_numpy(zero_copy_only=False) if self.splits else np.ones(len(texts), bool)
        out = dict(zip(np.flatnonzero(apart).tolist(), self.whole(texts.filter(pa.array(apart)).to_pylist()), strict=True))
        if len(rest := np.flatnonzero(~apart)):
            split = pc.split_pattern(texts.take(pa.array(rest)), " ")
            ends = split.offsets.to_numpy() - split.offsets[0].as_py()
            units = split.flatten().dictionary_encode()
            first = pc.binary_join_element_wise("", units.take(pa.array(ends[:-1])).cast(pa.string()), " ").dictionary_encode()
            names = pa.concat_arrays([units.dictionary, first.dictionary])
            if len(self.known) + len(names) > CACHE_UNITS:
                self.forget()
            place = pc.index_in(names, value_set=self.known).fill_null(-1).to_numpy().copy()
            if len(late := np.flatnonzero(place < 0)):
                new, missing = len(self.known), names.take(pa.array(late))
                self.learn(missing)
                place[late] = new + pc.index_in(missing, value_set=self.known.slice(new)).to_numpy()
            which = place[units.indices.to_numpy()]
            which[ends[:-1]] = place[len(units.dictionary) + first.indices.to_numpy()]
            stop = np.cumsum(self.n[which])[ends[1:] - 1]
            out |= zip(rest.tolist(), np.split(self.ids_of(which), stop[:-1]), strict=True)
        return [out[i] for i in range(len(texts))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# --- Re-Pair ---

NEVER, LATER = -2, -1


def repair(symbols: np.ndarray, ends: np.ndarray, vocabulary: int, rounds: int | None = None, most: int = PAIRS_A_ROUND, least: int = LEAST_COUNT):
    """Compressed symbols, their document ends, rules (n x 2) and their expansion lengths; at most ``rounds`` rounds, None for all."""
    s = symbols.astype(np.uint32)
    ends = ends.astype(np.int64)
    rules, lengths = np.empty((0, 2), np.int64), np.ones(vocabulary, np.int64)
    inside = np.ones(len(s), bool)  # whether a symbol and the next are of one document
    inside[ends[ends > 0] - 1] = False
    inside[-1:] = False
    # a pair that was not frequent before can only become so with a new symbol in it, so the others are left alone
    live = inside.copy()
    for _ in islice(count(), rounds):
        room = min(most, (1 << 16) - len(lengths))
        places = np.flatnonzero(live)
        if not places.size or room <= 0:
            break
        pair = s[places] << np.uint32(16) | s[places + 1]
        order = np.sort(pair)
        head = np.flatnonzero(np.append(True, order[1:] != order[:-1]))
        times = np.diff(head, append=len(order))
        often = np.flatnonzero(times >= least)
        if not often.size:
            break
        frequent = order[head[often]]
        chosen = frequent[np.argsort(-times[often], kind="stable")[:room]]
        # a table by the pairs' hashes: a chosen pair's number, LATER for other frequent ones; of chosen pairs that clash one waits
        table = np.full(1 << 20, NEVER, np.int32)
        slot = lambda p: (p * np.uint32(0x9E3779B1)) >> np.uint32(12)
        table[slot(frequent)] = LATER
        table[slot(chosen)] = np.arange(len(chosen))
        which = table[slot(pair)]
        live[places[which == NEVER]] = False
        hit = np.flatnonzero(which >= 0)
        hit = hit[chosen[which[hit]] == pair[hit]]
        at, which = places[hit], which[hit]
        # of overlapping places in a row take the first, third, ...
        run = np.flatnonzero(np.diff(at, prepend=-9) != 1)
        take = (at - np.repeat(at[run], np.diff(run, append=len(at)))) % 2 == 0
        at, which = at[take], which[take]
        used = np.flatnonzero(np.bincount(which, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.uint32)
        number[used] = len(lengths) + np.arange(len(used))
        new = np.column_stack([chosen[used] >> np.uint32(16), chosen[used] & np.uint32(0xFFFF)]).astype(np.int64)
        s[at] = number[which]
        inside[at] = inside[at + 1]
        live[at] = inside[at]
        before = at[at > 0] - 1
        live[before] = inside[before]
        ends = ends - np.searchsorted(at + 1, ends)
        left = np.ones(len(s), bool)
        left[at + 1] = False
        s, inside, live = s[left], inside[left], live[left]
        rules = np.vstack([rules, new])
        lengths = np.concatenate([lengths, lengths[new[:, 0]] + lengths[new[:, 1]]])
    return s.astype("<u2"), ends, rules, lengths[vocabulary:]


def _unfold(s: np.ndarray, starts: np.ndarray, widths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    width = widths[s]
    into = np.cumsum(width) - width
    return flat[np.arange(int(width.sum())) + np.repeat(starts[s] - into, width)]


def expand(symbols: np.ndarray, rules: np.ndarray, expansions: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of a run of symbols: one table of all rules' ids, then one gather."""
    widths = np.concatenate([np.ones(vocabulary, np.int64), expansions.astype(np.int64)])
    starts = np.cumsum(widths) - widths
    flat = np.arange(vocabulary)
    done = 0
    while done < len(rules):  # a round's rules refer to symbols of earlier rounds only
        new = rules[done:]
        ready = int(np.argmax(np.append((new >= vocabulary + done).any(axis=1), True)))
        flat = np.concatenate([flat, _unfold(new[:ready].ravel(), starts, widths, flat)])
        done += ready
    return _unfold(symbols.astype(np.int64), starts, widths, flat).astype("<u4")


def read_ids(shard: dict, j: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start:stop`` of the j-th document of a shard: only the symbols that overlap them are expanded."""
    rules = np.frombuffer(shard["rules"], "<u2").reshape(-1, 2).astype(np.int64)
    expansions, v = np.frombuffer(shard["expansions"], "<u4").astype(np.int64), shard["vocabulary"]
    ends = np.frombuffer(shard["doc_ends"], "<u4")
    run = np.frombuffer(shard["symbols"], "<u2")[int(ends[j - 1]) if j else 0 : int(ends[j])].astype(np.int64)
    until = np.cumsum(np.where(run >= v, expansions[np.maximum(run - v, 0)], 1)) if len(expansions) else np.arange(1, len(run) + 1)
    stop = int(until[-1]) if stop is None else min(stop, int(until[-1]))
    if stop <= start:
        return np.empty(0, "<u4")
    a, b = int(np.searchsorted(until, start, side="right")), int(np.searchsorted(until, stop, side="left"))
    before = int(until[a - 1]) if a else 0
    return expand(run[a : b + 1], rules, expansions, v)[start - before : stop - before]


# --- writing and reading ---


def _shard(part: int, number: int, docs: list, ids: list[np.ndarray], vocabulary: int, rounds: int | None) -> dict:
    n = np.array([len(x) for x in ids], np.int64)
    symbols, ends, rules, expansions = repair(np.concatenate(ids), np.cumsum(n), vocabulary, rounds)
    return {
        "part": part, "shard": number, "docs": docs, "n_tokens": int(n.sum()), "vocabulary": vocabulary, "symbols": symbols.tobytes(),
        "doc_ends": ends.astype("<u4").tobytes(), "n_ids": n.astype("<u4").tobytes(), "rules": rules.astype("<u2").tobytes(), "expansions": expansions.astype("<u4").tobytes(),
    }


ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("docs", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("vocabulary", pa.int32()),
                   *((c, pa.binary()) for c in ("symbols", "doc_ends", "n_ids", "rules", "expansions"))])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, rounds: int | None = None) -> None:
    """Write ``docs`` (doc_id, text) in ascending doc_id order."""

    def run(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], "<u2")
        names, ids, size, number = [], [], 0, 0
        for batch in gathered(batches, BATCH_TEXT):  # the fewer, the fewer distinct units to look up
            for doc_id, found in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1)), strict=True):
                names.append(doc_id)
                ids.append(np.concatenate([found, end]))
                size += len(ids[-1])
                if size >= shard_tokens:
                    yield pa.RecordBatch.from_pylist([_shard(part, number, names, ids, enc.size, rounds)], ARROW)
                    names, ids, size, number = [], [], 0, number + 1
        if names:
            yield pa.RecordBatch.from_pylist([_shard(part, number, names, ids, enc.size, rounds)], ARROW)

    # the place in the input tells equal rows apart, so that many of them are spread over several parts
    rows = in_batches(docs).select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "digest", "place").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    rows.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, part, shard, place: one row per document, from the files."""

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                v = shard["vocabulary"]
                rules, expansions = np.frombuffer(shard["rules"], "<u2").reshape(-1, 2).astype(np.int64), np.frombuffer(shard["expansions"], "<u4")
                ids = expand(np.frombuffer(shard["symbols"], "<u2"), rules, expansions, v)
                n = np.frombuffer(shard["n_ids"], "<u4").astype(np.int64)
                at = np.concatenate([[0], np.cumsum(n)])
                held = memoryview(ids).cast("B")
                crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                k = len(n)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(shard["docs"], pa.int64()), "offset": pa.array(at[:-1], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    "part": pa.array([shard["part"]] * k, pa.int32()), "shard": pa.array([shard["shard"]] * k, pa.int32()), "place": pa.array(range(k), pa.int32()),
                })

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    docs = files.mapInArrow(run, "doc_id long, offset long, n_tokens long, ids_crc32 long, part int, shard int, place int")
    # where a shard starts: sums over the parts (as many rows as there are files), then within a part
    index = files.select("part", "shard", "n_tokens")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = index.join(parts, "part").select("part", "shard", (F.col("base") + within).alias("base"))
    rows = docs.join(starts, ["part", "shard"])
    return rows.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "place")


def store(docs: DataFrame, tokenizer: str | None = None, **settings) -> DataFrame:
    """Write ``docs`` to the shared folder and read the index of documents back."""
    path = f"{shared_dir(docs.sparkSession)}/tidemark-tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer or default_tokenizer(), **settings)
    return read_tokens(docs.sparkSession, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
