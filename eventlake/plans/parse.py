"""Raw message parsing, the same for batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.json_values import parsed, string_or_empty, string_or_null
from eventlake.functions.text import null_if_blank
from eventlake.functions.times import parse_or_epoch, parse_or_now


def landed(messages: DataFrame) -> DataFrame:
    """Raw message wrapped as a landing row."""
    return messages.select(F.col("value").alias("payload"))


def parse_payload(raw_payload: DataFrame, include_event_type: bool = False) -> DataFrame:
    """Payload text to typed events.

    Missing keys, JSON nulls and values that are no strings read as ''; times that do not parse
    read as 1970-01-01. ``event_type`` names an event only if asked for.
    """
    names = ["event", "event_name"] + (["event_type"] if include_event_type else [])
    fields = [*names, "campaign_id", "user_id", "occurred_at"]
    opened = raw_payload.select("payload", parsed(F.col("payload")).alias("_json"))
    # one column per field, so that no later expression reads the document again
    read = opened.select("payload", *[string_or_empty(F.col("_json"), field).alias(f"_{field}") for field in fields])
    return read.select(
        F.coalesce(*[null_if_blank(F.col(f"_{name}")) for name in names], F.lit("")).alias("event_name"),
        F.col("_campaign_id").alias("campaign_id"),
        F.col("_user_id").alias("user_id"),
        parse_or_epoch(F.col("_occurred_at")).alias("occurred_at"),
        "payload",
    )


def normalize_events(raw_payload: DataFrame, as_of: Column) -> DataFrame:
    """Payload text to event rows with an id: the given one or the md5 of the canonical text.

    Text that is not JSON gives no row.
    """
    fields = ["event_id", "event_name", "event_type", "campaign_id", "user_id", "page_url", "occurred_at"]
    opened = raw_payload.select(parsed(F.col("payload")).alias("_json")).where(F.col("_json").isNotNull())
    read = opened.select(
        *[null_if_blank(string_or_null(F.col("_json"), field)).alias(f"_{field}") for field in fields],
        F.to_json("_json").alias("payload"),
    )
    moment = F.date_trunc("millisecond", parse_or_now(F.col("_occurred_at"), as_of))
    return read.select(
        F.coalesce("_event_id", F.md5("payload")).alias("event_id"),
        F.coalesce("_event_name", "_event_type").alias("event_name"),
        F.col("_campaign_id").alias("campaign_id"),
        F.col("_user_id").alias("user_id"),
        F.col("_page_url").alias("page_url"),
        moment.alias("occurred_at"),
        "payload",
        F.to_date(moment).alias("event_date"),
    )
