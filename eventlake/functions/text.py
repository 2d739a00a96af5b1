"""Text rules: ids, slugs, routes, keys, search matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.json_values import strip, text_field
from eventlake.functions.times import stamp

# A character that starts a new word after it: white space, or ASCII other than letters, digits and underscore.
WORD_BREAK = r"[\s\p{IsWhite_Space}]|[\x00-\x7F&&[^A-Za-z0-9_]]"


def null_if_blank(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def non_blank(value: Column) -> Column:
    """The value unless it is NULL or only white space."""
    return F.when(strip(value) != "", value)


def first_non_blank(*values: Column) -> Column:
    """First value that is not blank, else ''."""
    return F.coalesce(*[non_blank(value) for value in values], F.lit(""))


def key_hash(*parts: Column) -> Column:
    """md5 of colon-joined keys; NULL if any key is NULL."""
    pieces = []
    for part in parts:
        pieces += [F.lit(":"), part]
    return F.md5(F.concat(*pieces[1:]))


def slug(value: Column) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 becomes one inner hyphen."""
    hyphenated = F.regexp_replace(F.lower(strip(value)), "[^a-z0-9]+", "-")
    return F.regexp_replace(hyphenated, "^-+|-+$", "")


def route_path(route: Column) -> Column:
    path = strip(F.coalesce(route, F.lit("")))
    return (
        F.when(path.isin("", "/"), fx.DASHBOARD_ROUTE)
        .when(path.startswith("/"), path)
        .otherwise(F.concat(F.lit("/"), path))
    )


def title_words(value: Column) -> Column:
    """Hyphens to spaces and a capital at each word start; later letters keep their case."""
    letters = F.split(F.replace(value, F.lit("-"), F.lit(" ")), "")

    def cased(letter: Column, position: Column) -> Column:
        before = F.get(letters, position - 1)
        return F.when(before.isNull() | before.rlike(WORD_BREAK), F.upper(letter)).otherwise(letter)

    return F.array_join(F.transform(letters, cased), "")


def default_campaign_title(action: Column) -> Column:
    return title_words(F.coalesce(non_blank(strip(action)), F.lit(fx.BRIEF_ACTION_FALLBACK)))


def generated_id(prefix: Column, when: Column) -> Column:
    return F.concat_ws("-", prefix, stamp(when))


def is_campaign_placeholder(value: Column) -> Column:
    return strip(F.coalesce(value, F.lit(""))).isin(*fx.CAMPAIGN_PLACEHOLDERS)


def subscriber_key(subject_id: Column, metadata: Column, when: Column) -> Column:
    """Subscriber id: first usable slug of subject, given id, email local part or name."""
    nothing = F.lit(None).cast("string")
    candidates = [strip(subject_id)] + [text_field(metadata, key, nothing) for key in ("subscriberId", "email", "name")]

    def usable(candidate: Column) -> Column:
        named = F.nullif(candidate, F.lit(fx.SUBSCRIBER_PLACEHOLDER))
        return null_if_blank(slug(F.substring_index(named, "@", 1)))

    return F.coalesce(*[usable(candidate) for candidate in candidates], generated_id(F.lit("subscriber"), when))


def object_topic(object_key: Column) -> Column:
    """Second part of a key below the bronze prefix, else ``unknown``."""
    parts = F.split(object_key, "/")
    below_bronze = (F.size(parts) > 1) & (F.get(parts, F.lit(0)) == fx.BRONZE_PREFIX)
    return F.when(below_bronze, F.get(parts, F.lit(1))).otherwise(fx.UNKNOWN_TOPIC)


def padded(number: Column, width: int = 5) -> Column:
    """Right-aligned with spaces; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, " "))


def whole_number(value: Column) -> Column:
    """Whole number of a mixed value, cutting decimals; unreadable values read as 0."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"), F.lit(0).cast("long"))


def matches_words(query: str, *columns: Column) -> Column:
    """Case-insensitive substring match over joined columns; a blank query matches all."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))


def has_tag(tags: Column, wanted: str) -> Column:
    """Case-insensitive tag membership; the all-contacts tag matches everyone."""
    if wanted == fx.ALL_CONTACTS:
        return F.lit(True)
    return F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda tag: F.lower(tag) == wanted.lower())
