"""Fill-in-middle transformation (operator 12).

A text is cut into units, runs of ASCII letters or single other code points, and
rearranged so that a model learns to write what stands between two ends: form
``psm`` is prefix, suffix, middle and ``spm`` suffix, prefix, middle, each part
after its sentinel; ``plain`` is the text as it is.

Units are not listed.  One Aho-Corasick automaton reads a text once, as one ASCII
symbol for each code point, and reports where an ASCII letter meets another
character and where a sentinel stands.  Between two such events lies either one
run of letters, which is one unit, or a stretch of m other characters, which is m
units, so the units before every event are known by arithmetic and the place of
any unit is found by bisection over the events.

The ends are drawn from four 32-bit numbers of a SHA-256 of seed and doc_id, so
reruns agree and rows need no order.  ``restored`` rebuilds the text from output
and form with Spark expressions; it is exact because texts that hold a sentinel
stay plain and sentinels do not overlap one another.

Defined cases: null text is empty; empty texts and those that hold a sentinel
stay plain; a null doc_id draws as the text ``null``; repeated rows are
transformed each for itself, rows of one doc_id with the same draws; a whole text
is one value in one task, whatever its length; an empty table stays one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, table, whole_row

SENTINELS = ("<P>", "<S>", "<M>")
SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20
LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Scanner:
    """Events of texts: ``n`` units, where units lie, whether a sentinel stands in the text."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        import ahocorasick

        for a in sentinels:
            for b in sentinels:
                if not a or a != b and a in b or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) + (a != b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} overlap, so texts could not be restored")
        named = set("".join(sentinels).encode("ascii", "replace"))
        #: What is no part of a sentinel is one symbol for letters and one for all else.
        self.symbol = bytes(c if c in named else 0x61 if c in LETTERS else 0x2E for c in range(256))
        letters = {chr(self.symbol[c]) for c in LETTERS}
        others = {chr(self.symbol[c]) for c in range(128) if c not in LETTERS}
        found: dict[str, tuple[bool, tuple[str, ...]]] = {pair: (True, ()) for a in letters for b in others for pair in (a + b, b + a)}
        for s in sentinels:
            change, held = found.get(self.symbols(s), (False, ()))
            found[self.symbols(s)] = change, (*held, s)
        self.events = ahocorasick.Automaton()
        for pattern, value in found.items():
            self.events.add_word(pattern, value)
        self.events.make_automaton()

    def symbols(self, text: str) -> str:
        """One ASCII character for each code point."""
        return text.encode("ascii", "replace").translate(self.symbol).decode("ascii")

    def scan(self, text: str) -> Units:
        bounds, marked = [0], False
        for last, (change, sentinels) in self.events.iter(self.symbols(text)):
            if change:
                bounds.append(last)
            marked |= any(text.startswith(s, last + 1 - len(s)) for s in sentinels)  # symbols stand for several characters
        bounds.append(len(text))
        return Units(np.array(bounds, np.int64), bool(text) and ord(text[0]) in LETTERS, marked)


class Units:
    """Stretches of a text between events, by turns of letters and of other characters."""

    def __init__(self, bounds: np.ndarray, letters_first: bool, marked: bool):
        self.bounds, self.marked = bounds, marked
        units = np.diff(bounds)
        self.letters = np.arange(len(units)) % 2 == (0 if letters_first else 1)
        units[self.letters] = 1
        self.until = np.cumsum(units)
        self.n = int(self.until[-1])

    def place(self, units: int) -> int:
        """Code points that the first ``units`` units take."""
        if units == 0:
            return 0
        j = int(np.searchsorted(self.until, units))
        return int(self.bounds[j + 1]) - (0 if self.letters[j] else int(self.until[j]) - units)


_SCANNERS: dict[tuple[str, ...], Scanner] = {}


def scanner(sentinels: tuple[str, ...]) -> Scanner:
    """One for each Python worker."""
    if sentinels not in _SCANNERS:
        _SCANNERS[sentinels] = Scanner(sentinels)
    return _SCANNERS[sentinels]


def draws(doc_id: object, seed: str = SEED) -> list[int]:
    """Four 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearranged(doc_id: object, text: str, sentinels: tuple[str, ...] = SENTINELS, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> tuple:
    """n, form, prefix_chars, middle_chars, output."""
    units = scanner(sentinels).scan(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or units.marked or h3 % 100 >= plain_from:
        return units.n, "plain", None, None, text
    a, b = sorted((units.place(h1 % (units.n + 1)), units.place(h2 % (units.n + 1))))
    p, s, m = sentinels
    psm = h4 % 100 >= spm_below
    output = "".join((p, text[:a], s, text[b:], m, text[a:b]) if psm else (s, text[b:], p, text[:a], m, text[a:b]))
    return units.n, "psm" if psm else "spm", a, b - a, output


TOLD = "n long, form string, prefix_chars long, middle_chars long, output string"
KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())


def transformed(docs: DataFrame, keep: list[str] | None = None, sentinels: tuple[str, ...] = SENTINELS, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``doc`` (a struct of the columns ``keep``, default all), n, form, prefix_chars, middle_chars, output of each row of ``docs``.

    Of 100 texts about 100 - ``plain_from`` stay plain; ``spm_below`` of 100 others are spm.
    """
    scanner(sentinels)  # sentinels that overlap are refused here
    keep = keep or docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [rearranged(i, t or "", sentinels, seed, plain_from, spm_below) for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = zip(*told, strict=True) if told else [[]] * len(KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, KINDS, strict=True))], ["doc", *TOLD.replace(",", "").split()[::2]])

    kept = T.StructField("doc", T.StructType([docs.schema[c] for c in keep]))
    rows = in_batches(docs).select(whole_row(docs.select(*(f"`{c.replace('`', '``')}`" for c in keep))).alias("doc"), docs["doc_id"].cast("string"), "text")
    return rows.mapInArrow(run, T.StructType([kept, *T._parse_datatype_string(TOLD).fields]))


def restored(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text that ``transformed`` was given, from what it gave."""
    p, s, m = sentinels
    body, middle = F.split_part(output, F.lit(m), F.lit(1)), F.split_part(output, F.lit(m), F.lit(2))
    after = lambda mark, until: F.split_part(F.split_part(body, F.lit(mark), F.lit(2)), F.lit(until), F.lit(1))
    return F.when(form == "plain", output).otherwise(F.concat(after(p, s), middle, after(s, p)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    digest = lambda c: F.sha2(c, 256)
    return rows.select(
        "doc.doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
hashed AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM drawn),
formed AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                 WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM hashed),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM formed),
cut AS (
  SELECT doc_id, n, form, t, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
         CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts)
SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM cut
"""
