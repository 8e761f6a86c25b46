"""Scalar expressions: built-in functions only, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROW_SEPARATOR = "\x01"
NULL_TOKEN = "_null_"
UNKNOWN_KEY = "-1"

#: Seconds that `timestamp_seconds` takes without overflow.
LEAST_SECONDS, MOST_SECONDS = -9_223_372_036_854, 9_223_372_036_854


def clean_cast(col: str | Column, kind: str) -> Column:
    """The trimmed text as `kind`, or null where it is none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c).try_cast(kind)


def whole_text(col: str) -> Column:
    """The trimmed text where it is a whole number, as text, else null."""
    return F.when(clean_cast(col, "bigint").isNotNull(), F.trim(col))


def unless_sentinel(value: Column, sentinel: int = -1) -> Column:
    return F.nullif(value, F.lit(sentinel))


def flag(col: str | Column) -> Column:
    """True for 1, false for any other whole number, null for none."""
    return clean_cast(col, "int") == 1


def instant(seconds: Column, anchor_epoch: int) -> Column:
    """A time from seconds after an anchor; null where it would overflow."""
    total = F.try_add(seconds, F.lit(anchor_epoch).cast("long"))
    return F.when(total.between(LEAST_SECONDS, MOST_SECONDS), F.timestamp_seconds(total))


def row_key(columns: list[str]) -> Column:
    """SHA-256 of a row's raw text columns; null counts as empty."""
    return F.sha2(F.concat_ws(ROW_SEPARATOR, *[F.coalesce(F.col(c), F.lit("")) for c in columns]), 256)


def surrogate_key(*values: Column) -> Column:
    return F.md5(F.concat_ws("-", *[F.coalesce(v.cast("string"), F.lit(NULL_TOKEN)) for v in values]))


def date_key(day: Column) -> Column:
    """YYYYMMDD as a whole number."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def ratio_or_null(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def seconds_between(a: Column, b: Column) -> Column:
    """Second boundaries crossed from a to b."""
    return F.unix_seconds(b.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def pseudonym(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(value.cast("string"), F.lit(salt)), 256)


def bucket(key: Column, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n) if isinstance(n, int) else n)


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose predicate is true, else null."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(fails, name).otherwise(out)
    return out
