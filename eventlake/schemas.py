"""Schemas, keys and layout of every table and message."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "decimal(5,2)": T.DecimalType(5, 2), "variant": T.VariantType(),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _schema(columns: str) -> T.StructType:
    """Columns as ``name type [not null]``; unlike a DDL parse it needs no session."""
    schema = T.StructType()
    for column in columns.split(", "):
        name, kind, *rest = column.split()
        schema.add(name, TYPES[kind], nullable=rest != ["not", "null"])
    return schema


@dataclass(frozen=True)
class TableSpec:
    """One table: columns, primary key, cell of a row and order inside files.

    ``cell`` is an expression over the key or date columns; rows of one cell lie in files of their own, so a change
    opens the cells it touches. Its values are numbers or dates: their number does not grow with tenants.
    """

    name: str
    schema: T.StructType
    keys: tuple[str, ...] = ()
    cell: str | None = None
    order: tuple[str, ...] = ()


ENVIRONMENT_TEXTS = (
    "brand_name", "brand_tagline", "hero_title", "hero_accent", "hero_note", "search_placeholder",
    "session_label", "session_node", "session_status", "campaigns_headline", "campaigns_description",
    "subscribers_headline", "subscribers_description", "analytics_headline", "analytics_description",
    "security_title", "security_status", "security_description", "billing_eyebrow", "billing_title",
    "billing_date", "billing_action",
)


def _tenant_table(name: str, columns: str, keys: tuple[str, ...], cells: int = 4, cell: str | None = None) -> TableSpec:
    """Rows of tenants, ordered by tenant and key inside files. Tables of many rows per tenant pass more cells, which
    then also cut by the first key below the tenant; children lie in the cell of their parent."""
    every = ("environment", *keys)
    hashed = f"pmod(xxhash64({', '.join(every[:2] if cells > 4 else every[:1])}), {cells})"
    return TableSpec(name, _schema("environment string not null, " + columns), every, cell or hashed, every)


APP_TABLES = (
    _tenant_table(
        "platform_environment",
        ", ".join(f"{text} string not null" for text in ENVIRONMENT_TEXTS) + ", updated_at timestamp not null",
        (),
    ),
    _tenant_table("platform_filter", "filter_label string not null, display_order bigint not null", ("filter_label",)),
    _tenant_table(
        "platform_dashboard_activity",
        "activity_id string not null, title string not null, description string not null, "
        "occurred_at timestamp not null, tone string not null, display_order bigint not null",
        ("activity_id",),
    ),
    _tenant_table(
        "platform_growth_segment",
        "segment_id string not null, label string not null, percentage decimal(5,2) not null, display_order bigint not null",
        ("segment_id",),
    ),
    _tenant_table(
        "platform_campaign",
        "campaign_id string not null, title string not null, summary string not null, status string not null, "
        "audience_count int not null, audience_label string not null, action_label string not null, "
        "tone string not null, display_order bigint not null",
        ("campaign_id",),
        16,
    ),
    _tenant_table(
        "platform_subscriber",
        "subscriber_id string not null, name string not null, email string not null, security_status string not null, "
        "created_at timestamp not null, last_interaction_at timestamp, tone string not null, "
        "is_featured boolean not null, display_order bigint not null",
        ("subscriber_id",),
        16,
    ),
    _tenant_table(
        "platform_subscriber_segment",
        "subscriber_id string not null, segment_label string not null, display_order bigint not null",
        ("subscriber_id", "segment_label"),
        16,
    ),
    _tenant_table(
        "platform_filter_assignment",
        "subscriber_id string not null, filter_label string not null",
        ("subscriber_id", "filter_label"),
        16,
    ),
    _tenant_table(
        "platform_analytics_pipeline",
        "pipeline_id string not null, title string not null, description string not null, status string not null, "
        "display_order bigint not null",
        ("pipeline_id",),
    ),
    _tenant_table(
        "platform_analytics_signal",
        "signal_id string not null, title string not null, description string not null, action string not null, "
        "event_kind string not null, subject_type string not null, subject_id string not null, display_order bigint not null",
        ("signal_id",),
    ),
    _tenant_table(
        "platform_campaign_analytics",
        "campaign_id string not null, delivered_recipients bigint not null, open_recipients bigint not null, "
        "click_recipients bigint not null, bounce_recipients bigint not null, first_seen_at timestamp, "
        "last_seen_at timestamp, refreshed_at timestamp not null",
        ("campaign_id",),
        16,
    ),
    _tenant_table(
        "platform_engagement_analytics",
        "page_url string not null, event_name string not null, event_count bigint not null, unique_users bigint not null, "
        "first_seen_at timestamp, last_seen_at timestamp, refreshed_at timestamp not null, display_order bigint not null",
        ("page_url", "event_name"),
        16,
    ),
    _tenant_table(
        "platform_daily_performance",
        "bucket_date date not null, event_count bigint not null, refreshed_at timestamp not null",
        ("bucket_date",),
        cell="bucket_date",
    ),
)

LAKE_TABLES = (
    TableSpec(
        "raw_third_party_records",
        _schema(
            "record_id string not null, provider string not null, account_id string, collected_at timestamp not null, "
            "payload string not null"
        ),
        keys=("record_id",),
    ),
    TableSpec(
        "raw_object_index",
        _schema(
            "object_key string, etag string, source_topic string, last_modified timestamp, processed_at timestamp, "
            "processed_date date, size bigint"
        ),
        keys=("object_key",),
        cell="processed_date",
        order=("object_key",),
    ),
    TableSpec(
        "third_party_snapshots",
        _schema(
            "record_id string, provider string, account_id string, collected_at timestamp, captured_at timestamp, "
            "captured_date date, object_key string, payload string"
        ),
        cell="captured_date",
        order=("provider", "record_id"),
    ),
    TableSpec("load_audit", _schema("dataset string, rows bigint, run_id string, recorded_at timestamp")),
)

SERVING_TABLES = (
    TableSpec("raw_payload", _schema("payload string")),
    TableSpec(
        "raw_events",
        _schema("event_name string, campaign_id string, user_id string, occurred_at timestamp not null, payload string"),
        cell="to_date(occurred_at)",
        order=("occurred_at",),
    ),
    TableSpec(
        "campaign_performance",
        _schema(
            "campaign_id string not null, delivered_events bigint, open_events bigint, click_events bigint, "
            "first_seen_at timestamp, last_seen_at timestamp"
        ),
        order=("campaign_id",),
    ),
    TableSpec(
        "product_engagement",
        _schema(
            "page_url string not null, event_name string not null, event_count bigint, unique_users bigint, "
            "first_seen_at timestamp, last_seen_at timestamp"
        ),
        order=("page_url", "event_name"),
    ),
)

TABLES = {spec.name: spec for spec in APP_TABLES + LAKE_TABLES + SERVING_TABLES}

# Columns a table must have before it may be kept; a table that lacks one is reset.
REQUIRED_COLUMNS = {
    "platform_campaign_analytics": (
        "environment", "campaign_id", "delivered_recipients", "open_recipients", "click_recipients", "bounce_recipients",
    ),
    "platform_engagement_analytics": ("environment", "page_url", "event_name", "event_count", "unique_users"),
}

EMAIL_EVENT = _schema(
    "event_id string, campaign_id string, recipient_id string, event_type string, occurred_at string, payload string, "
    "correlation_id string"
)
ANALYTICS_EVENT = _schema(
    "event_id string, session_id string, user_id string, event_name string, page_url string, occurred_at string, "
    "payload string, correlation_id string"
)
PARTNER_RECORD = _schema("record_id string, provider string, account_id string, collected_at string, payload variant")
COMMAND = _schema(
    "command_id string, environment string, session_id string, user_id string, route string, surface string, "
    "action string, subject_type string, subject_id string, campaign_id string, recipient_id string, event_kind string, "
    "metadata string, occurred_at timestamp"
)
METRIC_SAMPLE = _schema("metric string, labels map<string,string>, ts timestamp, value double")
REQUEST_LOG = _schema("service string, method string, route string, status int, ts timestamp, request_id bigint")
RUN_LOG = _schema("run_id string, op_name string, status string, duration_ms double, ts timestamp")
