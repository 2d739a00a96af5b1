"""Trace lookups, trace gaps and free-text searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.text import has_tag, matches_words


def payloads_with(raw_payload: DataFrame, trace_id: str) -> DataFrame:
    return raw_payload.where(F.contains("payload", F.lit(trace_id)))


def events_of_trace(raw_events: DataFrame, trace_id: str) -> DataFrame:
    """Parsed events of a campaign or trace id, newest first."""
    hit = (F.col("campaign_id") == trace_id) | F.contains("payload", F.lit(trace_id))
    return raw_events.where(hit).orderBy(F.desc("occurred_at"))


def missing_downstream(upstream: DataFrame, downstream: DataFrame, key: str) -> DataFrame:
    """Upstream rows whose id never arrived. Repeated and missing ids downstream are reduced first."""
    arrived = downstream.select(key).where(F.col(key).isNotNull()).distinct()
    return upstream.join(arrived, key, "left_anti")


def search_campaigns(campaigns: DataFrame, query: str) -> DataFrame:
    return campaigns.where(matches_words(query, F.col("title"), F.col("summary"), F.col("audience_label")))


def search_subscribers(subscribers: DataFrame, query: str, tag: str = fx.ALL_CONTACTS) -> DataFrame:
    """Name or e-mail match and tag match; ``subscribers`` carries a ``filter_tags`` array."""
    return subscribers.where(matches_words(query, F.col("name"), F.col("email")) & has_tag(F.col("filter_tags"), tag))
