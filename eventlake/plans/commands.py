"""Batches of user commands: validation, normalization, event fan-out and table changes.

Commands of one key apply in order of (occurred_at, command_id). The order is folded into
per-key aggregates, so a key with many commands is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.json_values import int_field, object_text, parsed, strings_field, strip, text_field
from eventlake.functions.text import (
    default_campaign_title,
    first_non_blank,
    generated_id,
    is_campaign_placeholder,
    key_hash,
    non_blank,
    route_path,
    slug,
    subscriber_key,
)
from eventlake.operators.merge import next_order
from eventlake.operators.ordering import last_per_key, numbered
from eventlake.session import pinned

TENANT = "environment"
COMMAND_ORDER = ("occurred_at", "command_id")
TEXT_FIELDS = (
    "session_id", "user_id", "route", "surface", "action", "subject_type", "subject_id", "campaign_id", "recipient_id", "event_kind",
)


def is_valid() -> Column:
    """Surface and action are not blank."""
    return non_blank(F.col("surface")).isNotNull() & non_blank(F.col("action")).isNotNull()


def validate(commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected commands, the latter with a reason."""
    reason = F.when(non_blank(F.col("surface")).isNull(), "surface is required").otherwise("action is required")
    return commands.where(is_valid()), commands.where(~is_valid()).withColumn("reason", reason)


def _or_default(name: str, default: Column | str) -> Column:
    value = F.col(name)
    return F.when(value == "", default).otherwise(value)


def needs_campaign() -> Column:
    return (
        F.col("event_kind").isin("email", "both") | (F.col("subject_type") == "campaign") | (F.col("action") == fx.CREATE_BRIEF)
    )


def normalize(commands: DataFrame) -> DataFrame:
    """Defaults, and the campaign a campaign command is about.

    A generated session is a hash of the command id, so that a replay gives the same one.
    """
    filled = commands.withColumns({name: F.coalesce(F.col(name), F.lit("")) for name in TEXT_FIELDS})
    defaulted = filled.withColumns({
        "session_id": _or_default("session_id", generated_token("session", F.col("command_id"))),
        "user_id": _or_default("user_id", F.lit(fx.DEFAULT_USER)),
        "route": _or_default("route", F.lit(fx.DEFAULT_ROUTE)),
        "event_kind": _or_default("event_kind", F.lit(fx.DEFAULT_KIND)),
        "metadata": F.when(parsed(F.col("metadata")).isNull(), "{}").otherwise(F.col("metadata")),
    })
    placeholder = is_campaign_placeholder(F.col("subject_id"))
    derived = (
        F.when(~placeholder, strip(F.col("subject_id"))).otherwise(generated_id(slug(F.col("action")), F.col("occurred_at")))
    )
    identified = defaulted.withColumn(
        "campaign_id", F.when(needs_campaign() & (F.col("campaign_id") == ""), derived).otherwise(F.col("campaign_id"))
    )
    return identified.withColumn(
        "subject_id", F.when((F.col("action") == fx.CREATE_BRIEF) & placeholder, F.col("campaign_id")).otherwise(F.col("subject_id"))
    )


def generated_token(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.md5(key), 1, 12))


# fan-out to events


def publishes_analytics() -> Column:
    return F.col("event_kind") != "email"


def publishes_email() -> Column:
    kind = F.col("event_kind")
    in_campaign = (F.col("subject_type") == "campaign") | (F.col("campaign_id") != "")
    return kind.isin("email", "both") | ((kind != "analytics") & in_campaign)


def published_channels() -> Column:
    return F.array_compact(F.array(F.when(publishes_analytics(), "analytics"), F.when(publishes_email(), "email")))


def fan_out(normalized: DataFrame) -> DataFrame:
    """One row per event a command publishes, none to two."""
    opened = normalized.withColumn("_meta", parsed(F.col("metadata")))
    metadata = F.col("_meta")
    page = route_path(F.col("route"))
    nothing = F.lit(None).cast("string")
    campaign = first_non_blank(F.col("campaign_id"), F.col("subject_id"), F.lit(fx.EMAIL_CAMPAIGN_FALLBACK))
    analytics_payload = object_text(
        surface=F.col("surface"), action=F.col("action"), subject_type=F.col("subject_type"), subject_id=F.col("subject_id"),
        campaign_id=F.col("campaign_id"), metadata=metadata,
    )
    email_payload = object_text(
        route=page, surface=F.col("surface"), subject_type=F.col("subject_type"), subject_id=F.col("subject_id"), metadata=metadata
    )

    def event(channel: str, **columns: Column) -> Column:
        members = {"channel": F.lit(channel), "event_id": key_hash(F.col("command_id"), F.lit(channel)), **columns}
        return F.struct(*[value.alias(name) for name, value in members.items()])

    analytics = event(
        "analytics", session_id=F.col("session_id"), user_id=F.col("user_id"),
        event_name=F.concat(slug(F.col("surface")), F.lit("."), slug(F.col("action"))), page_url=page,
        campaign_id=nothing, recipient_id=nothing, event_type=nothing, payload=analytics_payload,
    )
    email = event(
        "email", session_id=nothing, user_id=nothing, event_name=nothing, page_url=nothing, campaign_id=campaign,
        recipient_id=F.col("recipient_id"), event_type=F.concat(F.lit(fx.EMAIL_TYPE_PREFIX), slug(F.col("action"))), payload=email_payload,
    )
    both = F.array_compact(F.array(F.when(publishes_analytics(), analytics), F.when(publishes_email(), email)))
    return opened.select("command_id", TENANT, "occurred_at", F.inline(both))


# table changes


def action_is(name: str) -> Column:
    return strip(F.col("action")) == name


def campaign_of_command() -> Column:
    """Campaign a stored command is about, '' if none."""
    return strip(first_non_blank(F.col("campaign_id"), F.col("subject_id")))


def _moment() -> Column:
    return F.struct(*COMMAND_ORDER)


@dataclass
class CampaignChanges:
    campaigns: DataFrame  # whole rows to upsert
    new_analytics: DataFrame  # zero rows of created campaigns, to insert where absent
    rejected: DataFrame  # launch commands without a campaign


def campaign_changes(normalized: DataFrame, campaigns: DataFrame) -> CampaignChanges:
    """Briefs create or rewrite a campaign, launches schedule one that exists by then."""
    keys = [TENANT, "campaign_id"]
    targeted = normalized.withColumn("campaign_id", campaign_of_command())
    named = F.col("campaign_id") != ""
    opened = targeted.where(action_is(fx.CREATE_BRIEF) & named).withColumn("_meta", parsed(F.col("metadata")))
    nameless = targeted.where(action_is(fx.CREATE_BRIEF) & ~named)
    launches = targeted.where(action_is(fx.LAUNCH_TEST_SEND))

    meta = F.col("_meta")
    brief = F.struct(
        text_field(meta, "title", default_campaign_title(F.col("action"))).alias("title"),
        text_field(meta, "summary", F.lit(fx.BRIEF_DEFAULTS["summary"])).alias("summary"),
        text_field(meta, "status", F.lit(fx.BRIEF_DEFAULTS["status"])).alias("status"),
        int_field(meta, "audienceCount", fx.BRIEF_DEFAULTS["audienceCount"], "int").alias("audience_count"),
        text_field(meta, "audienceLabel", F.lit(fx.BRIEF_DEFAULTS["audienceLabel"])).alias("audience_label"),
        text_field(meta, "actionLabel", F.lit(fx.BRIEF_DEFAULTS["actionLabel"])).alias("action_label"),
        text_field(meta, "tone", F.lit(fx.BRIEF_DEFAULTS["tone"])).alias("tone"),
    )
    moment = _moment().alias("moment")
    asked = opened.select(*keys, moment, brief.alias("brief")).unionByName(launches.where(named).select(*keys, moment), allowMissingColumns=True)
    written = F.when(F.col("brief").isNotNull(), F.col("moment"))
    folded = asked.groupBy(*keys).agg(
        F.min(written).alias("first_brief"),
        F.max(written).alias("last_brief"),
        F.max_by("brief", written).alias("brief"),
        F.max(F.when(F.col("brief").isNull(), F.col("moment"))).alias("last_launch"),
    )
    touched = folded.join(campaigns.withColumn("stored", F.lit(True)), keys, "left")

    def known(launch: Column) -> Column:
        """A launch finds its campaign stored or created before it."""
        return F.col("stored").isNotNull() | F.coalesce(launch > F.col("first_brief"), F.lit(False))

    judged = launches.join(touched.select(*keys, "stored", "first_brief"), keys, "left")
    missed = judged.where(~known(_moment())).select(*normalized.columns)
    rejected = missed.unionByName(nameless).withColumn(
        "reason", F.when(F.col("campaign_id") == "", "campaign ID is required").otherwise("campaign was not found")
    )
    # of a campaign's launches the last finds it if any does
    launch_counts = F.col("last_launch").isNotNull() & known(F.col("last_launch"))
    current = touched.where(F.col("last_brief").isNotNull() | launch_counts)
    launched_last = launch_counts & (
        F.col("last_brief").isNull() | F.coalesce(F.col("last_launch") > F.col("last_brief"), F.lit(False))
    )

    def value(name: str) -> Column:
        briefed = F.when(F.col("brief").isNotNull(), F.col("brief")[name]).otherwise(F.col(name))
        if name in fx.SCHEDULED_VALUES:
            return F.when(launched_last, fx.SCHEDULED_VALUES[name]).otherwise(briefed).alias(name)
        return briefed.alias(name)

    fields = ["title", "summary", "status", "audience_count", "audience_label", "action_label", "tone"]
    resolved = current.select(*keys, *[value(name) for name in fields], "display_order", F.col("first_brief.*"))
    fresh = resolved.where(F.col("display_order").isNull())
    ordered = number_new(fresh, campaigns, COMMAND_ORDER).select(*keys, F.col("display_order").alias("new_order"))
    changed = (
        resolved.join(ordered, keys, "left")
        .withColumn("display_order", F.coalesce("display_order", "new_order"))
        .select(*campaigns.columns)
    )
    zero = F.lit(0).cast("long")
    never = F.lit(None).cast("timestamp")
    new_analytics = folded.where(F.col("first_brief").isNotNull()).select(
        *keys,
        *[zero.alias(f"{name}_recipients") for name in ("delivered", "open", "click", "bounce")],
        never.alias("first_seen_at"),
        never.alias("last_seen_at"),
        F.col("first_brief.occurred_at").alias("refreshed_at"),
    )
    return CampaignChanges(changed, new_analytics, rejected)


def number_new(fresh: DataFrame, target: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Consecutive order numbers after the tenant's highest, in command order."""
    last = next_order(target, [TENANT], "display_order")
    ranked = numbered(fresh.drop("display_order"), [TENANT], list(order), "position")
    return ranked.join(last, TENANT, "left").withColumn("display_order", F.col("position") + F.coalesce("last_order", F.lit(0)))


@dataclass
class SubscriberChanges:
    subscribers: DataFrame  # whole rows to upsert
    segments: DataFrame  # new segment rows of the touched subscribers
    assignments: DataFrame  # new tag rows of the touched subscribers
    filters: DataFrame  # filter labels to add


def subscriber_changes(normalized: DataFrame, subscribers: DataFrame, filters: DataFrame) -> SubscriberChanges:
    """The last add command of a subscriber wins; creation time and order number stay with the first."""
    keys = [TENANT, "subscriber_id"]
    defaults = fx.SUBSCRIBER_DEFAULTS
    meta = F.col("_meta")
    opened = normalized.where(action_is(fx.ADD_SUBSCRIBER)).withColumn("_meta", parsed(F.col("metadata")))
    subscriber = subscriber_key(F.col("subject_id"), meta, F.col("occurred_at"))
    adds = opened.withColumn("subscriber_id", subscriber).select(
        *keys,
        *COMMAND_ORDER,
        text_field(meta, "name", F.lit(defaults["name"])).alias("name"),
        text_field(meta, "email", F.concat(F.col("subscriber_id"), F.lit(fx.SUBSCRIBER_EMAIL_DOMAIN))).alias("email"),
        text_field(meta, "securityStatus", F.lit(defaults["securityStatus"])).alias("security_status"),
        text_field(meta, "tone", F.lit(defaults["tone"])).alias("tone"),
        strings_field(meta, "assignedSegments", defaults["assignedSegments"]).alias("segments"),
        strings_field(meta, "filterTags", defaults["filterTags"]).alias("tags"),
    )
    latest = last_per_key(adds, keys, list(COMMAND_ORDER))
    first = adds.groupBy(*keys).agg(F.min(_moment()).alias("first"))

    stored = subscribers.select(*keys, "created_at", F.col("display_order").alias("stored_order"))
    resolved = latest.join(first, keys).join(stored, keys, "left")
    fresh = resolved.where(F.col("stored_order").isNull()).select(*keys, "first.*")
    ordered = number_new(fresh, subscribers, COMMAND_ORDER).select(*keys, F.col("display_order").alias("new_order"))
    changed = resolved.join(ordered, keys, "left").select(
        *keys,
        "name",
        "email",
        "security_status",
        F.coalesce("created_at", "first.occurred_at").alias("created_at"),
        F.col("occurred_at").alias("last_interaction_at"),
        "tone",
        F.lit(True).alias("is_featured"),
        F.coalesce("stored_order", "new_order").alias("display_order"),
    )

    def labels(column: str, name: str) -> DataFrame:
        return latest.select(*keys, F.col(column).alias("all"), F.explode(F.array_distinct(column)).alias(name))

    segments = labels("segments", "segment_label").select(
        *keys, "segment_label", F.array_position("all", F.col("segment_label")).alias("display_order")
    )
    assignments = labels("tags", "filter_label").select(*keys, "filter_label")

    named = adds.select(TENANT, *COMMAND_ORDER, F.posexplode("tags").alias("tag_position", "filter_label"))
    mention = F.struct(*COMMAND_ORDER, "tag_position")
    new_labels = (
        named.groupBy(TENANT, "filter_label")
        .agg(F.min(mention).alias("mention"))
        .join(filters.select(TENANT, "filter_label"), [TENANT, "filter_label"], "left_anti")
        .select(TENANT, "filter_label", "mention.*")
    )
    new_filters = number_new(new_labels, filters, (*COMMAND_ORDER, "tag_position")).select(
        TENANT, "filter_label", "display_order"
    )
    return SubscriberChanges(changed, segments, assignments, new_filters)


@dataclass
class Outcome:
    results: DataFrame  # one row per accepted command
    rejected: DataFrame  # commands refused, with a reason
    events: DataFrame  # events of accepted commands
    campaigns: CampaignChanges
    subscribers: SubscriberChanges


def results_of(accepted: DataFrame) -> DataFrame:
    """Answer per accepted command."""
    stored = strip(F.col("action")).isin(fx.CREATE_BRIEF, fx.LAUNCH_TEST_SEND, fx.ADD_SUBSCRIBER)
    return accepted.select(
        "command_id",
        F.lit(True).alias("accepted"),
        stored.alias("stored"),
        "session_id",
        generated_token("trace", F.col("command_id")).alias("correlation_id"),
        "campaign_id",
        published_channels().alias("published"),
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"),
    )


def process(commands: DataFrame, tables: Mapping[str, DataFrame]) -> Outcome:
    """Everything a batch of commands does. Refused commands change no table and emit no event."""
    valid, invalid = validate(commands)
    normalized = pinned(normalize(valid))  # read by every step below
    campaigns = campaign_changes(normalized, tables["platform_campaign"])
    subscribers = subscriber_changes(normalized, tables["platform_subscriber"], tables["platform_filter"])
    accepted = normalized.join(campaigns.rejected.select("command_id"), "command_id", "left_anti")
    rejected = invalid.unionByName(campaigns.rejected)
    return Outcome(results_of(accepted), rejected, fan_out(accepted), campaigns, subscribers)
