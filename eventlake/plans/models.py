"""SQL models: staging views, marts and the serving casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.json_values import object_text
from eventlake.functions.text import key_hash
from eventlake.functions.times import to_seconds


def stg_email_events(campaign_analytics: DataFrame, as_of: Column) -> DataFrame:
    payload = object_text(
        environment=F.col("environment"),
        delivered_events=F.col("delivered_recipients"),
        open_events=F.col("open_recipients"),
        click_events=F.col("click_recipients"),
        bounce_events=F.col("bounce_recipients"),
        source=F.lit(fx.CAMPAIGN_SOURCE),
    )
    return campaign_analytics.select(
        key_hash(F.col("environment"), F.col("campaign_id")).alias("event_id"),
        "campaign_id",
        F.lit(None).cast("string").alias("recipient_id"),
        F.lit(fx.CONSOLIDATED_EVENT_TYPE).alias("event_type"),
        F.coalesce("last_seen_at", "refreshed_at", as_of).alias("occurred_at"),
        payload.alias("payload"),
    )


def stg_analytics_events(engagement_analytics: DataFrame, as_of: Column) -> DataFrame:
    payload = object_text(
        environment=F.col("environment"),
        event_count=F.col("event_count"),
        unique_users=F.col("unique_users"),
        source=F.lit(fx.ENGAGEMENT_SOURCE),
    )
    return engagement_analytics.select(
        key_hash(F.col("environment"), F.col("page_url"), F.col("event_name")).alias("event_id"),
        F.lit(None).cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("user_id"),
        "event_name",
        "page_url",
        F.coalesce("last_seen_at", "refreshed_at", as_of).alias("occurred_at"),
        payload.alias("payload"),
    )


def stg_third_party_records(records: DataFrame) -> DataFrame:
    return records.select("record_id", "provider", "account_id", "collected_at", "payload")


def _seen(name: str) -> Column:
    return F.coalesce(name, "refreshed_at").alias(name)


def mart_campaign_performance(campaign_analytics: DataFrame) -> DataFrame:
    """The tenant is dropped on purpose: one row per tenant and campaign stays."""
    return campaign_analytics.select(
        "campaign_id",
        F.col("delivered_recipients").alias("delivered_events"),
        F.col("open_recipients").alias("open_events"),
        F.col("click_recipients").alias("click_events"),
        _seen("first_seen_at"),
        _seen("last_seen_at"),
    )


def mart_product_engagement(engagement_analytics: DataFrame) -> DataFrame:
    return engagement_analytics.select(
        "page_url", "event_name", "event_count", "unique_users", _seen("first_seen_at"), _seen("last_seen_at")
    )


def _serving(mart: DataFrame, keys: list[Column], counts: tuple[str, ...]) -> DataFrame:
    return mart.select(
        *keys,
        *[F.col(name).cast("long").alias(name) for name in counts],
        *[to_seconds(F.col(name)).alias(name) for name in ("first_seen_at", "last_seen_at")],
    )


def serving_campaign_performance(mart: DataFrame) -> DataFrame:
    return _serving(mart, [F.col("campaign_id")], ("delivered_events", "open_events", "click_events"))


def serving_product_engagement(mart: DataFrame) -> DataFrame:
    keys = [F.coalesce(name, F.lit("")).alias(name) for name in ("page_url", "event_name")]
    return _serving(mart, keys, ("event_count", "unique_users"))
