"""Number, percentage and time labels, and SQL literal quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.times import micros_before

MICROS_PER_SECOND = 1_000_000


def exact_ratio(numerator: Column, denominator: Column, factor: int = 100) -> Column:
    """``numerator * factor / denominator`` in decimal arithmetic, NULL for a zero denominator."""
    top = numerator.cast("decimal(20,1)") * F.lit(factor).cast("decimal(4,0)")
    return F.try_divide(top, denominator.cast("decimal(19,0)"))


def one_decimal(value: Column) -> Column:
    """Plain text with one decimal place, rounded half up, without grouping."""
    return F.round(value, 1).cast("decimal(20,1)").cast("string")


def format_integer(value: Column) -> Column:
    """Thousands grouping; NULL reads as 0."""
    return F.format_number(F.coalesce(value.cast("long"), F.lit(0).cast("long")), 0)


def format_compact(value: Column) -> Column:
    """``950``, ``220.3k`` or ``1.2m``; NULL reads as 0."""
    exact = value.cast("decimal(20,0)")
    return (
        F.when(value.isNull(), "0")
        .when(value >= 1_000_000, F.concat(one_decimal(exact * F.lit("0.000001").cast("decimal(6,6)")), F.lit("m")))
        .when(value >= 1_000, F.concat(one_decimal(exact * F.lit("0.001").cast("decimal(3,3)")), F.lit("k")))
        .otherwise(format_integer(value))
    )


def format_percent(value: Column) -> Column:
    """``26.7%``; NULL stays NULL."""
    return F.concat(one_decimal(value), F.lit("%"))


def relative_time(value: Column, as_of: Column) -> Column:
    """Age of ``value`` at ``as_of``: a rounded-down unit below a week, then a date."""
    age = micros_before(value, as_of)
    seconds = F.floor(age / F.lit(MICROS_PER_SECOND))

    def ago(unit_seconds: int, unit: str) -> Column:
        return F.concat(F.floor(seconds / F.lit(unit_seconds)).cast("string"), F.lit(f" {unit} ago"))

    def younger_than(unit_seconds: int) -> Column:
        return age < F.lit(unit_seconds * MICROS_PER_SECOND)

    return (
        F.when(value.isNull(), fx.NO_ACTIVITY)
        .when(younger_than(60), fx.JUST_NOW)
        .when(younger_than(3_600), ago(60, "minutes"))
        .when(younger_than(86_400), ago(3_600, "hours"))
        .when(younger_than(7 * 86_400), ago(86_400, "days"))
        .otherwise(F.date_format(value, fx.DATE_LABEL))
    )


def last_sync_label(value: Column, as_of: Column) -> Column:
    return F.concat(F.lit(fx.SYNC_PREFIX), F.lower(relative_time(value, as_of)))


def day_label(day: Column) -> Column:
    """Three-letter week day."""
    return F.date_format(day, "E")


def sql_literal(value: Column) -> Column:
    """Quoted SQL text: quotes doubled, backslashes in the E'' form, NULL as the bare word."""
    text = value.cast("string")
    doubled = F.replace(text, F.lit("'"), F.lit("''"))
    escaped = F.replace(doubled, F.lit("\\"), F.lit("\\\\"))
    quoted = F.when(
        F.contains(text, F.lit("\\")), F.concat(F.lit("E'"), escaped, F.lit("'"))
    ).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))
    return F.coalesce(quoted, F.lit("NULL"))


def sql_bare(value: Column) -> Column:
    """Unquoted SQL text; NULL prints as nothing."""
    return F.coalesce(value.cast("string"), F.lit(""))
