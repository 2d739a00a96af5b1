"""Column helpers that several native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# One word: a run of characters other than space and the ASCII controls from tab to carriage return.
WORD_BREAKS = r"[ \t\n\x0B\f\r]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other letter stays."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column, breaks: str = WORD_BREAKS) -> Column:
    """Words as an array; no text gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), breaks), lambda word: word != "")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) drawn from the parts by MD5, the same on every run and engine."""
    digest = F.md5(F.concat_ws(":", *[part.cast("string") for part in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often and however deep ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of letters."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
