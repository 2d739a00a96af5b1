"""Consolidation of events into the three aggregate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consolidate_campaign(email_events: DataFrame, refreshed_at: Column) -> DataFrame:
    """Distinct recipients per tenant and campaign that were delivered, opened, clicked, bounced.

    Recipients are reduced to one row first. Both steps combine before they shuffle, so a
    campaign with most of the events is spread over its recipients.
    """
    flags = ("delivered", "open", "click", "bounce")
    per_recipient = email_events.groupBy("environment", "campaign_id", "recipient_id").agg(
        *[F.max(F.col(f"is_{flag}").cast("int")).alias(flag) for flag in flags],
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
    )
    known = F.col("recipient_id").isNotNull()
    return (
        per_recipient.groupBy("environment", "campaign_id")
        .agg(
            *[F.coalesce(F.sum(F.when(known, F.col(flag))), F.lit(0)).cast("long").alias(f"{flag}_recipients") for flag in flags],
            F.min("first_at").alias("first_seen_at"),
            F.max("last_at").alias("last_seen_at"),
        )
        .withColumn("refreshed_at", refreshed_at)
    )


def consolidate_engagement(page_events: DataFrame, refreshed_at: Column) -> DataFrame:
    """Events and distinct users per tenant, page and event name."""
    return (
        page_events.groupBy("environment", "page_url", "event_name")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_distinct("user_id").alias("unique_users"),
            F.min("occurred_at").alias("first_seen_at"),
            F.max("occurred_at").alias("last_seen_at"),
        )
        .withColumn("refreshed_at", refreshed_at)
    )


def consolidate_daily(events: DataFrame, refreshed_at: Column) -> DataFrame:
    """Events per tenant and day."""
    return (
        events.groupBy("environment", F.to_date("occurred_at").alias("bucket_date"))
        .agg(F.count(F.lit(1)).alias("event_count"))
        .withColumn("refreshed_at", refreshed_at)
    )
