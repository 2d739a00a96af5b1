"""Typed reads from JSON text.

``get_json_object`` turns numbers into text, so string reads go through VARIANT,
which keeps the JSON type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = " \t\n\v\f\r\u0085\u00a0"


def strip(text: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes blanks only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def parsed(text: Column) -> Column:
    """JSON text as VARIANT, NULL when it is not valid JSON."""
    return F.try_parse_json(text)


def _field(document: Column, key: str) -> Column:
    return F.try_variant_get(document, f"$.{key}", "variant")


def _type_of(document: Column, key: str) -> Column:
    return F.schema_of_variant(_field(document, key))


def string_or_null(document: Column, key: str) -> Column:
    """The value if it is a JSON string, else NULL."""
    return F.when(
        F.equal_null(_type_of(document, key), F.lit("STRING")), F.try_variant_get(document, f"$.{key}", "string")
    )


def string_or_empty(document: Column, key: str) -> Column:
    """The value if it is a JSON string; missing, null and other types read as ''."""
    return F.coalesce(string_or_null(document, key), F.lit(""))


def text_field(document: Column, key: str, fallback: Column) -> Column:
    """Trimmed string value; missing, blank or non-string values give the fallback."""
    text = strip(string_or_null(document, key))
    return F.coalesce(F.nullif(text, F.lit("")), fallback)


def int_field(document: Column, key: str, fallback: int, kind: str = "long") -> Column:
    """Numeric value cut to a whole number; other types and numbers too large give the fallback."""
    found = _type_of(document, key)
    is_number = found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL")
    # a cast to a whole number cuts towards zero
    whole = F.try_variant_get(document, f"$.{key}", "double").try_cast(kind)
    return F.coalesce(F.when(is_number, whole), F.lit(fallback).cast(kind))


def strings_field(document: Column, key: str, fallback: tuple[str, ...]) -> Column:
    """Trimmed non-blank strings of an array; anything else, or none left, gives the fallback."""
    items = F.try_variant_get(document, f"$.{key}", "array<variant>")
    texts = F.transform(
        items,
        lambda item: F.when(
            F.schema_of_variant(item) == "STRING", strip(F.try_variant_get(item, "$", "string"))
        ),
    )
    kept = F.filter(texts, lambda text: text.isNotNull() & (text != ""))
    default = F.array(*[F.lit(text) for text in fallback])
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(default)


def canonical(text: Column) -> Column:
    """Compact JSON text with sorted keys at every level; NULL when it is not valid JSON."""
    return F.to_json(parsed(text))


def object_text(**fields: Column) -> Column:
    """JSON text of an object that keeps its NULL fields."""
    members = [value.alias(name) for name, value in fields.items()]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})
