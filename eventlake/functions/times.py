"""Clock-free time expressions; the current time is always an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlake import fixed_values as fx


def at(as_of: datetime | str | Column) -> Column:
    """An ``as_of`` argument as a timestamp column."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp")


def micros_before(value: Column, as_of: Column) -> Column:
    return F.unix_micros(as_of) - F.unix_micros(value)


def to_millis(value: Column) -> Column:
    """ISO text or timestamp, in UTC, cut to milliseconds."""
    return F.date_trunc("millisecond", F.try_to_timestamp(value.cast("string")))


def to_seconds(value: Column) -> Column:
    return F.date_trunc("second", value)


def parse_or_epoch(text: Column) -> Column:
    """Date-prefixed text as a timestamp in whole seconds, anything else as 1970-01-01."""
    parsed = F.when(text.rlike(fx.DATE_PREFIX_PATTERN), F.try_to_timestamp(text))
    return F.coalesce(to_seconds(parsed), F.timestamp_seconds(F.lit(0)))


def parse_or_now(text: Column, as_of: Column) -> Column:
    """ISO text as a timestamp; blank, missing or unreadable text reads as ``as_of``."""
    return F.coalesce(F.try_to_timestamp(F.nullif(text, F.lit(""))), as_of)


def stamp(value: Column) -> Column:
    """``yyyyMMddHHmmss`` suffix of generated ids."""
    return F.date_format(value, fx.ID_STAMP)


def iso_micros(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def window_start(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window a time falls in, as epoch seconds."""
    second = F.unix_seconds(ts)
    return second - F.pmod(second, F.lit(seconds).cast("long"))
