"""Scalar functions on columns; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..roles import NA_TOKENS

MINUTE = 60_000_000  # microseconds
# The unit of epoch numbers by their median, below all of these nanoseconds.
EPOCH_UNITS = (("epoch_us", 1e14), ("epoch_ms", 1e11), ("epoch_s", 1e8))
# Characters that names of files must not hold.
RESERVED = r'[<>:"/\\|?*\x00-\x1F]+'
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
TIMESTAMP_FORMATS = (
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]",
    "yyyy-MM-dd HH:mm:ss[XXX]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy",
)


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a UTC timestamp without zone."""
    return F.unix_micros(c.cast("timestamp"))


def not_available(c: Column) -> Column:
    """NULL for cells that mean "no value"."""
    return F.when(~c.isin(*NA_TOKENS), c)


def to_number(c: Column) -> Column:
    """DOUBLE of a plain decimal number, NULL of any other text."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_text_timestamp(c: Column) -> Column:
    """The first of TIMESTAMP_FORMATS that fits, as UTC without zone."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in TIMESTAMP_FORMATS)).cast("timestamp_ntz")


def from_epoch(number: Column, strategy: Column) -> Column:
    """UTC timestamp without zone of an epoch number; NULL beyond the years 1 to 9999."""
    factor = F.when(strategy == "epoch_us", 1.0).when(strategy == "epoch_ms", 1e3).when(strategy == "epoch_s", 1e6).when(strategy == "epoch_ns", 1e-3)
    at = F.floor(number * factor)
    return F.when((number * factor).between(-62135596800e6, 253402300799e6), F.timestamp_micros(at.try_cast("long"))).cast("timestamp_ntz")


def sanitize(c: Column) -> Column:
    """A text fit for a path: NULL is empty, runs of reserved characters become "_", white space one blank."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(text, RESERVED, "_"), r"\s+", " ")


def redact(c: Column) -> Column:
    """The ends of a secret; short ones are hidden whole, NULL stays."""
    return F.when(c.isNotNull(), F.when(F.length(c) <= 8, "***").otherwise(F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4)))))


def label_or_name_or_id(label: Column, name: Column, id_: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(name, F.lit("")), id_)


def epoch_ms(local: Column, zone: str) -> Column:
    """Epoch milliseconds of a wall-clock time in a zone."""
    return F.unix_millis(F.to_utc_timestamp(local.cast("timestamp"), zone))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def matches(c: Column, pattern: str) -> Column:
    """Regular expression found anywhere, regardless of case; NULL does not match."""
    return F.coalesce(F.regexp_like(c, F.lit("(?i)" + pattern)), F.lit(False))


def named(name: Column, label: Column, wanted: list[str]) -> Column:
    """Trimmed name or label is one of the wanted; an empty list takes all."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.trim(name).isin(*wanted), F.lit(False)) | F.coalesce(F.trim(label).isin(*wanted), F.lit(False))


def round_half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def readable(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
