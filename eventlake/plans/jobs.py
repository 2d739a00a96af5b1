"""Batch jobs over a table store; an external scheduler calls them."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.times import at
from eventlake.operators.ordering import numbered
from eventlake.plans import audit, commands, models
from eventlake.plans.parse import parse_payload
from eventlake.plans.seed import seed_tables
from eventlake.schemas import REQUIRED_COLUMNS, TABLES
from eventlake.session import pinned
from eventlake.sources.bronze import index_rows, new_objects, object_listing, with_etags
from eventlake.sources.partner import RECORD_ORDER, raw_record_rows, snapshot_records, snapshot_rows
from eventlake.sources.store import TableStore


def bootstrap_tables(store: TableStore, names: Iterable[str] = TABLES) -> None:
    """Create every table that is missing."""
    for name in names:
        store.ensure(name)


def backfill_events(store: TableStore, include_event_type: bool = False, dates: Iterable[date] | None = None) -> None:
    """Parse all landed payloads into the events table, in place of what it holds, so that a second run adds nothing.

    With ``dates`` only events of these days are put in place, and files of other days stay as they are.
    """
    parsed = parse_payload(store.read("raw_payload"), include_event_type)
    if dates is None:
        store.replace("raw_events", parsed)
        return
    days = sorted({day.isoformat() for day in dates})
    store.reload_where("raw_events", F.to_date("occurred_at").cast("string").isin(days), parsed, cells=days)


def record_rows(store: TableStore, tables: dict[str, DataFrame], run_id: str, recorded_at: datetime) -> None:
    store.append("load_audit", audit.row_audit(tables, run_id, at(recorded_at)))


def ingest_partner_snapshot(store: TableStore, records: DataFrame, captured_at: datetime) -> None:
    """Log the snapshot, and store records whose id is new.

    A repeated run for the same capture time appends no second copy to the log.
    """
    rows = snapshot_rows(records, at(captured_at))
    logged = store.read("third_party_snapshots", cells=[captured_at.date().isoformat()])
    # equal keys, NULL with NULL: a record without a readable time is found again, too
    keys = ["object_key", "record_id", "collected_at", "payload"]
    known = logged.select(*[F.col(key).alias(f"_{key}") for key in keys])
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_{key}")) for key in keys])
    store.append("third_party_snapshots", rows.join(known, same, "left_anti"))
    store.insert_absent("raw_third_party_records", raw_record_rows(records), RECORD_ORDER)


def build_models(store: TableStore, as_of: datetime) -> dict[str, DataFrame]:
    """Staging models as views, marts as frames to publish."""
    campaign = store.read("platform_campaign_analytics")
    engagement = store.read("platform_engagement_analytics")
    models.stg_email_events(campaign, at(as_of)).createOrReplaceTempView("stg_email_events")
    models.stg_analytics_events(engagement, at(as_of)).createOrReplaceTempView("stg_analytics_events")
    models.stg_third_party_records(store.read("raw_third_party_records")).createOrReplaceTempView("stg_third_party_records")
    return {
        "mart_campaign_performance": models.mart_campaign_performance(campaign),
        "mart_product_engagement": models.mart_product_engagement(engagement),
    }


def publish_serving(store: TableStore, marts: dict[str, DataFrame]) -> None:
    """Replace both serving tables; readers switch from the old to the new rows at once."""
    store.replace("campaign_performance", models.serving_campaign_performance(marts["mart_campaign_performance"]))
    store.replace("product_engagement", models.serving_product_engagement(marts["mart_product_engagement"]))


def refresh_batch_and_serving(store: TableStore, snapshot_folder: str, captured_at: datetime, run_id: str, array: bool = True) -> None:
    """Daily job: partner snapshot (JSON arrays or, with ``array=False``, a record per line), models, serving tables, row counts."""
    records = snapshot_records(store.spark, snapshot_folder, array)
    ingest_partner_snapshot(store, records, captured_at)
    publish_serving(store, build_models(store, captured_at))
    loaded = ("raw_third_party_records", "campaign_performance", "product_engagement")
    record_rows(store, {name: store.read(name) for name in loaded}, run_id, captured_at)


def sync_object_metadata(store: TableStore, bronze_folder: str, processed_at: datetime, run_id: str, at_once: int = 10_000) -> None:
    """Hourly job: index the objects that are not indexed yet.

    The lake is listed without content; only the content of new objects is read, ``at_once`` of them per step, each
    of which adds its rows to the index, so a run that dies is taken up where it stopped.
    """
    listing = object_listing(store.spark, bronze_folder)
    fresh = pinned(numbered(new_objects(listing, store.read("raw_object_index")), [], ["object_key"], "number"))
    for step in range(-(-fresh.count() // at_once)):
        part = fresh.where(F.col("number").between(step * at_once + 1, (step + 1) * at_once))
        store.append("raw_object_index", index_rows(with_etags(part), at(processed_at)))
    record_rows(store, {"raw_object_index": store.read("raw_object_index")}, run_id, processed_at)


def load_seed(store: TableStore, as_of: datetime, members: int = fx.SEED_MEMBERS) -> None:
    """Delete the demo tenant and load it again."""
    for name, rows in seed_tables(store.spark, as_of, members).items():
        store.reload_tenant(name, "local", rows)


def apply_commands(store: TableStore, batch: DataFrame) -> commands.Outcome:
    """Apply a batch to the app tables. The caller publishes the events of the outcome.

    The outcome is pinned first, because each table write changes what the next step would read.
    """
    tables = {name: store.read(name) for name in ("platform_campaign", "platform_subscriber", "platform_filter")}
    outcome = commands.process(batch, tables)
    for part, names in ((outcome.campaigns, ("campaigns", "new_analytics")), (outcome.subscribers, ("subscribers", "segments", "assignments", "filters"))):
        for name in names:
            setattr(part, name, pinned(getattr(part, name)))
    outcome.results, outcome.rejected, outcome.events = (
        pinned(frame) for frame in (outcome.results, outcome.rejected, outcome.events)
    )
    campaign_columns = ["title", "summary", "status", "audience_count", "audience_label", "action_label", "tone"]
    store.upsert("platform_campaign", outcome.campaigns.campaigns, campaign_columns)
    store.insert_absent("platform_campaign_analytics", outcome.campaigns.new_analytics, ["refreshed_at"])
    touched = outcome.subscribers.subscribers.select("environment", "subscriber_id")
    subscriber_columns = ["name", "email", "security_status", "last_interaction_at", "tone", "is_featured"]
    store.upsert("platform_subscriber", outcome.subscribers.subscribers, subscriber_columns)
    parents = ["environment", "subscriber_id"]
    store.replace_children("platform_subscriber_segment", touched, outcome.subscribers.segments, parents)
    store.replace_children("platform_filter_assignment", touched, outcome.subscribers.assignments, parents)
    store.insert_absent("platform_filter", outcome.subscribers.filters, ["display_order"])
    return outcome


def reset_drifted(store: TableStore) -> list[str]:
    """Drop consolidated tables that lack a required column; they are created anew when next used."""
    present = [store.columns(name) for name in REQUIRED_COLUMNS if store.exists(name)]
    if not present:
        return []
    catalogue = present[0]
    for columns in present[1:]:
        catalogue = catalogue.unionByName(columns)
    drift = audit.schema_drift(audit.required_columns(store.spark), catalogue)
    if drift.isEmpty():
        return []
    # one consolidated table drifted: both are reset
    names = [name for name in REQUIRED_COLUMNS if store.exists(name)]
    for name in names:
        store.drop(name)
    return names
