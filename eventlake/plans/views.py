"""Dashboard views and the dashboard document."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.text import whole_number
from eventlake.functions.formats import (
    day_label,
    exact_ratio,
    format_compact,
    format_integer,
    format_percent,
    last_sync_label,
    one_decimal,
    relative_time,
)
from eventlake.operators.ordering import ordered_list, page_block, page_numbers
from eventlake.sources.generators import with_days

TENANT = "environment"


def _zero(column: Column | str) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long")


def campaign_live_metrics(campaign_analytics: DataFrame) -> DataFrame:
    """Counts and rates per campaign; a rate without denominator is NULL."""
    counts = {name: _zero(f"{name}_recipients") for name in ("delivered", "open", "click", "bounce")}

    def rate(part: str, whole: Column, digits: int) -> Column:
        return F.round(exact_ratio(counts[part], whole), digits)

    return campaign_analytics.select(
        TENANT,
        "campaign_id",
        *[value.alias(f"{name}_recipients") for name, value in counts.items()],
        rate("open", counts["delivered"], 1).alias("open_rate"),
        rate("click", counts["delivered"], 1).alias("click_rate"),
        rate("delivered", counts["delivered"] + counts["bounce"], 2).alias("deliverability_rate"),
        "first_seen_at",
        "last_seen_at",
        "refreshed_at",
    )


def dashboard_metrics(environments: DataFrame, subscribers: DataFrame, campaign_analytics: DataFrame, as_of: Column) -> DataFrame:
    """Three figures per tenant; tenants without data read 0."""
    members = subscribers.groupBy(TENANT).agg(
        F.count(F.lit(1)).alias("members"),
        F.count_if(F.col("created_at") >= F.date_trunc("month", as_of)).alias("new_members"),
    )
    mail = campaign_analytics.groupBy(TENANT).agg(
        *[F.sum(f"{name}_recipients").alias(name) for name in ("delivered", "open", "click")]
    )
    figures = (
        environments.select(TENANT)
        .join(members, TENANT, "left")
        .join(mail, TENANT, "left")
        .fillna(0, ["members", "new_members", "delivered", "open", "click"])
    )

    def rate_text(name: str) -> Column:
        return format_percent(F.coalesce(exact_ratio(F.col(name), F.col("delivered")), F.lit(0).cast("decimal(3,1)")))

    def card(texts: tuple, value: Column, delta: Column) -> Column:
        key, label, accent, icon, detail, position = texts
        return F.struct(
            F.lit(key).alias("id"), F.lit(label).alias("label"), value.alias("value"), delta.alias("delta"),
            F.lit(accent).alias("accent"), F.lit(icon).alias("icon"), F.lit(detail).alias("detail"),
            F.lit(position).alias("display_order"),
        )

    growth = exact_ratio(F.col("new_members"), F.greatest(F.col("members"), F.lit(1)))
    cards = F.array(
        card(fx.SUBSCRIBERS_CARD, format_integer(F.col("members")), F.concat(F.lit("+"), one_decimal(growth), F.lit(fx.THIS_MONTH_TEXT))),
        card(fx.OPEN_RATE_CARD, rate_text("open"), F.concat(format_integer(F.col("open")), F.lit(fx.OPENS_TEXT))),
        card(fx.CLICK_RATE_CARD, rate_text("click"), F.concat(format_integer(F.col("click")), F.lit(fx.CLICKS_TEXT))),
    )
    return figures.select(TENANT, F.inline(cards))


def campaign_summary(campaigns: DataFrame, campaign_analytics: DataFrame) -> DataFrame:
    """Reach, engagement and deliverability per tenant that has campaigns.

    Engagement is the plain mean of the rounded open rates of sent campaigns.
    """
    live = campaign_live_metrics(campaign_analytics).select(
        TENANT, "campaign_id", "open_rate", "delivered_recipients", "bounce_recipients"
    )
    sent = F.col("status") == fx.SENT_STATUS
    rated = sent & F.col("open_rate").isNotNull()
    totals = (
        campaigns.select(TENANT, "campaign_id", "status", "audience_count")
        .join(live, [TENANT, "campaign_id"], "left")
        .groupBy(TENANT)
        .agg(
            F.sum(F.col("audience_count").cast("long")).alias("reach"),
            F.count_if(sent).alias("sent"),
            F.sum(F.when(rated, F.col("open_rate"))).alias("rate_sum"),
            F.count_if(rated).alias("rate_count"),
            F.sum(_zero("delivered_recipients")).alias("delivered"),
            F.sum(_zero("bounce_recipients")).alias("bounced"),
        )
    )
    average = exact_ratio(F.col("rate_sum"), F.col("rate_count"), factor=1)
    delivered_share = F.round(exact_ratio(F.col("delivered"), F.col("delivered") + F.col("bounced")), 2)
    deliverability = F.coalesce(delivered_share, F.lit(0).cast("decimal(5,2)"))
    progress = F.greatest(F.lit(0), F.least(F.lit(100), F.round(deliverability, 0).cast("int")))

    def card(texts: tuple, value: Column, detail: Column, bar: Column) -> Column:
        key, label, tone, position = texts
        return F.struct(
            F.lit(key).alias("id"), F.lit(label).alias("label"), value.alias("value"), detail.alias("detail"),
            F.lit(tone).alias("tone"), bar.alias("progress"), F.lit(position).alias("display_order"),
        )

    cards = F.array(
        card(fx.REACH_CARD, format_compact(F.col("reach")), F.concat(F.col("sent").cast("string"), F.lit(fx.SENT_CAMPAIGNS_TEXT)), F.lit(0)),
        card(
            fx.ENGAGEMENT_CARD,
            F.coalesce(format_percent(average), F.lit(fx.ZERO_PERCENT)),
            F.concat(format_integer(F.col("delivered")), F.lit(fx.DELIVERIES_TEXT)),
            F.lit(0),
        ),
        card(fx.DELIVERABILITY_CARD, format_percent(deliverability), F.concat(format_integer(F.col("bounced")), F.lit(fx.BOUNCES_TEXT)), progress),
    )
    return totals.select(TENANT, F.inline(cards))


def dashboard_bars(environments: DataFrame, daily_performance: DataFrame, as_of: Column) -> DataFrame:
    """Seven gap-filled days per tenant, scaled to the busiest; that one (the later of equals) is emphasized."""
    first_day = F.date_sub(F.to_date(as_of), fx.BAR_DAYS - 1)
    recent = daily_performance.where(F.col("bucket_date").between(first_day, F.to_date(as_of)))
    days = with_days(environments.select(TENANT), as_of)
    filled = days.join(recent.select(TENANT, "bucket_date", "event_count"), [TENANT, "bucket_date"], "left").withColumn(
        "event_count", _zero("event_count")
    )
    # seven rows per tenant
    tenant = Window.partitionBy(TENANT)
    busiest = F.greatest(F.max("event_count").over(tenant), F.lit(1))
    height = F.round(exact_ratio(F.col("event_count"), busiest, factor=fx.BAR_MAX_HEIGHT), 0).cast("int")
    rank = F.row_number().over(tenant.orderBy(F.desc("event_count"), F.desc("bucket_date")))
    return filled.select(
        TENANT,
        day_label(F.col("bucket_date")).alias("label"),
        format_compact(F.col("event_count")).alias("value"),
        F.greatest(F.lit(fx.BAR_MIN_HEIGHT), F.least(F.lit(fx.BAR_MAX_HEIGHT), height)).alias("height"),
        (rank == 1).alias("emphasis"),
        F.row_number().over(tenant.orderBy("bucket_date")).alias("display_order"),
        "bucket_date",
        "event_count",
    )


def last_sync(environments: DataFrame, campaign_analytics: DataFrame, engagement_analytics: DataFrame, daily_performance: DataFrame) -> DataFrame:
    """Latest change per tenant over its own row and the consolidated tables."""

    def latest(table: DataFrame, name: str, *columns: str) -> DataFrame:
        newest = [F.max(column) for column in columns]
        return table.groupBy(TENANT).agg((F.greatest(*newest) if len(newest) > 1 else newest[0]).alias(name))

    synced = (
        environments.select(TENANT, "updated_at")
        .join(latest(campaign_analytics, "campaigns_at", "refreshed_at", "last_seen_at"), TENANT, "left")
        .join(latest(engagement_analytics, "engagement_at", "refreshed_at", "last_seen_at"), TENANT, "left")
        .join(latest(daily_performance, "daily_at", "refreshed_at"), TENANT, "left")
    )
    return synced.select(TENANT, F.greatest("updated_at", "campaigns_at", "engagement_at", "daily_at").alias("synced_at"))


def subscriber_assignments(subscribers: DataFrame, segments: DataFrame, assignments: DataFrame, filters: DataFrame) -> DataFrame:
    """Ordered segment and tag arrays per subscriber; no entries give empty arrays.

    The table keys allow each label once per subscriber, which bounds the arrays.
    """
    keys = [TENANT, "subscriber_id"]
    segment_lists = segments.groupBy(*keys).agg(ordered_list(["display_order", "segment_label"], "segment_label").alias("assigned_segments"))
    tags = assignments.join(filters.select(TENANT, "filter_label", "display_order"), [TENANT, "filter_label"])
    tag_lists = tags.groupBy(*keys).agg(ordered_list(["display_order", "filter_label"], "filter_label").alias("filter_tags"))
    none = F.array().cast("array<string>")
    return (
        subscribers.select(*keys)
        .join(segment_lists, keys, "left")
        .join(tag_lists, keys, "left")
        .select(*keys, F.coalesce("assigned_segments", none).alias("assigned_segments"), F.coalesce("filter_tags", none).alias("filter_tags"))
    )


# the dashboard document


def _named(**columns: Column | str) -> Column:
    return F.struct(*[(F.col(value) if isinstance(value, str) else value).alias(name) for name, value in columns.items()])


def campaign_cards(campaigns: DataFrame, campaign_analytics: DataFrame) -> DataFrame:
    """Campaign entries of the document; rates only show for sent campaigns."""
    live = campaign_live_metrics(campaign_analytics).select(TENANT, "campaign_id", "open_rate", "click_rate")

    def shown(rate: str) -> Column:
        return F.coalesce(F.when(F.col("status") == fx.SENT_STATUS, format_percent(F.col(rate))), F.lit(fx.NO_RATE))

    entry = _named(
        id="campaign_id", title="title", summary="summary", status="status", audience=format_integer(F.col("audience_count")),
        audienceLabel="audience_label", openRate=shown("open_rate"), clickRate=shown("click_rate"),
        actionLabel="action_label", tone="tone",
    )
    return campaigns.join(live, [TENANT, "campaign_id"], "left").select(TENANT, "display_order", entry.alias("item"))


def subscriber_cards(tables: Mapping[str, DataFrame], as_of: Column) -> DataFrame:
    """Entries of featured subscribers; lists are only built for them."""
    featured = tables["platform_subscriber"].where("is_featured")
    keys = [TENANT, "subscriber_id"]
    of_featured = featured.select(*keys)
    lists = subscriber_assignments(
        of_featured,
        tables["platform_subscriber_segment"].join(of_featured, keys, "left_semi"),
        tables["platform_filter_assignment"].join(of_featured, keys, "left_semi"),
        tables["platform_filter"],
    )
    entry = _named(
        id="subscriber_id", name="name", email="email", securityStatus="security_status", assignedSegments="assigned_segments",
        filterTags="filter_tags", lastInteraction=relative_time(F.col("last_interaction_at"), as_of), tone="tone",
    )
    return featured.join(lists, keys).select(TENANT, "display_order", entry.alias("item"))


def document_items(tables: Mapping[str, DataFrame], as_of: Column) -> dict[str, DataFrame]:
    """Entries of every list of the document as rows (environment, display_order, item).

    This is the document for tenants of any size: nothing is collected.
    """
    analytics = tables["platform_campaign_analytics"]

    def entries(rows: DataFrame, entry: Column) -> DataFrame:
        return rows.select(TENANT, "display_order", entry.alias("item"))

    return {
        "metrics": entries(
            dashboard_metrics(tables["platform_environment"], tables["platform_subscriber"], analytics, as_of),
            _named(id="id", label="label", value="value", delta="delta", accent="accent", icon="icon", detail="detail"),
        ),
        "bars": entries(
            dashboard_bars(tables["platform_environment"], tables["platform_daily_performance"], as_of),
            _named(label="label", value="value", height="height", emphasis="emphasis"),
        ),
        "activities": entries(
            tables["platform_dashboard_activity"],
            _named(id="activity_id", title="title", description="description", at=relative_time(F.col("occurred_at"), as_of), tone="tone"),
        ),
        "segments": entries(
            tables["platform_growth_segment"], _named(id="segment_id", label="label", value=format_percent(F.col("percentage")))
        ),
        "stats": entries(
            campaign_summary(tables["platform_campaign"], analytics),
            _named(id="id", label="label", value="value", detail="detail", tone="tone", progress="progress"),
        ),
        "campaigns": campaign_cards(tables["platform_campaign"], analytics),
        "filters": entries(tables["platform_filter"], F.col("filter_label")),
        "subscribers": subscriber_cards(tables, as_of),
        "pipelines": entries(
            tables["platform_analytics_pipeline"], _named(id="pipeline_id", title="title", description="description", status="status")
        ),
        "signals": entries(
            tables["platform_analytics_signal"],
            _named(
                id="signal_id", title="title", description="description", action="action", eventKind="event_kind",
                subjectType="subject_type", subjectId="subject_id",
            ),
        ),
    }


# lists of three or seven entries per tenant
SHORT_LISTS = ("metrics", "bars", "stats")


def paged_items(tables: Mapping[str, DataFrame], as_of: Column, page_size: int | None) -> DataFrame:
    """All lists of the document as arrays, one row per tenant, and per page if a size is given.

    The entries of all lists run through one union, one join with their page numbers and one
    grouping. Page numbers are counted on the bare tables.
    """
    items = document_items(tables, as_of)

    def entries(name: str) -> DataFrame:
        return items[name].select(TENANT, F.lit(name).alias("list"), F.col("display_order").cast("long"), F.col("item").alias(name))

    def union(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), frames)

    sources = {
        "activities": tables["platform_dashboard_activity"],
        "segments": tables["platform_growth_segment"],
        "campaigns": tables["platform_campaign"],
        "filters": tables["platform_filter"],
        "subscribers": tables["platform_subscriber"].where("is_featured"),
        "pipelines": tables["platform_analytics_pipeline"],
        "signals": tables["platform_analytics_signal"],
    }
    positions = union([rows.select(TENANT, F.lit(name).alias("list"), "display_order") for name, rows in sources.items()])
    long = union([entries(name) for name in sources])
    if page_size is None:
        paged = long.withColumn("page", F.lit(0).cast("long"))
    else:
        numbers = page_numbers(positions, [TENANT, "list"], "display_order", page_size)
        blocks = long.withColumn("block", page_block(F.col("display_order"), page_size))
        paged = blocks.join(numbers, [TENANT, "list", "block"]).drop("block")
    short = union([entries(name) for name in SHORT_LISTS]).withColumn("page", F.lit(0).cast("long"))
    rows = paged.unionByName(short, allowMissingColumns=True)
    return rows.groupBy(TENANT, "page").agg(*[ordered_list(["display_order"], name).alias(name) for name in items])


def platform_bootstrap(tables: Mapping[str, DataFrame], as_of: Column, environment: str | None = None, page_size: int | None = None) -> DataFrame:
    """The dashboard document, six nested sections per tenant; ``environment`` picks one tenant.

    One row per tenant, the whole document, for a named tenant or tenants known to be small; the
    caller, never the data, may ask for pages of ``page_size`` entries instead. At scale and over all
    tenants, ``document_items`` gives the lists as rows and holds nothing together.
    """
    if environment is not None:
        tables = {name: table.where(F.col(TENANT) == environment) for name, table in tables.items()}
    heads = tables["platform_environment"]
    network = tables["platform_subscriber"].groupBy(TENANT).agg(F.count(F.lit(1)).alias("network_size"))
    synced = last_sync(
        heads, tables["platform_campaign_analytics"], tables["platform_engagement_analytics"], tables["platform_daily_performance"]
    )
    # the short lists give every tenant its page 0
    lists = paged_items(tables, as_of, page_size)
    document = lists.join(heads, TENANT).join(synced, TENANT).join(network, TENANT, "left")

    dashboard = _named(
        metrics="metrics",
        performance=_named(
            title=F.lit(fx.PERFORMANCE_TITLE), modes=F.array(*[F.lit(mode) for mode in fx.PERFORMANCE_MODES]),
            activeMode=F.lit(fx.PERFORMANCE_MODES[0]), bars="bars",
        ),
        activities="activities",
        segments="segments",
        securityCard=_named(title="security_title", status="security_status", description="security_description"),
        billingCard=_named(eyebrow="billing_eyebrow", title="billing_title", date="billing_date", action="billing_action"),
    )
    brand = _named(
        name="brand_name", tagline="brand_tagline", heroTitle="hero_title", heroAccent="hero_accent", heroNote="hero_note",
        lastSync=last_sync_label(F.col("synced_at"), as_of), searchPlaceholder="search_placeholder",
    )
    return document.select(
        TENANT,
        "page",
        brand.alias("brand"),
        _named(label="session_label", node="session_node", status="session_status").alias("session"),
        dashboard.alias("dashboard"),
        _named(headline="campaigns_headline", description="campaigns_description", stats="stats", items="campaigns").alias("campaigns"),
        _named(
            headline="subscribers_headline", description="subscribers_description", filters="filters",
            networkSize=format_integer(F.col("network_size")), items="subscribers",
        ).alias("subscribers"),
        _named(
            headline="analytics_headline", description="analytics_description", pipelines="pipelines", signals="signals"
        ).alias("analytics"),
    )


def document_json(document: DataFrame) -> DataFrame:
    """The sections as JSON text that keeps NULL fields."""
    sections = ("brand", "session", "dashboard", "campaigns", "subscribers", "analytics")
    return document.select(TENANT, "page", *[F.to_json(name, {"ignoreNullFields": "false"}).alias(name) for name in sections])


def serving_totals(campaign_performance: DataFrame) -> DataFrame:
    """Analytics section over all serving rows; one row even without data. A connector may give counts as text or with decimals."""
    totals = campaign_performance.agg(
        *[F.coalesce(F.sum(whole_number(F.col(f"{name}_events"))), F.lit(0)).alias(name) for name in ("open", "click", "delivered")]
    )
    key, title, description, status = fx.OVERLAY_PIPELINE
    stage = _named(id=F.lit(key), title=F.lit(title), description=F.lit(description), status=F.lit(status))
    signal = "struct<id:string,title:string,description:string,action:string,eventKind:string,subjectType:string,subjectId:string>"
    return totals.select(
        F.lit(fx.OVERLAY_HEADLINE).alias("headline"),
        F.format_string(fx.OVERLAY_DESCRIPTION, "open", "click", "delivered").alias("description"),
        F.array(stage).alias("pipelines"),
        F.array().cast(f"array<{signal}>").alias("signals"),
    )


def with_live_analytics(document: DataFrame, campaign_performance: DataFrame | None) -> DataFrame:
    """The document with its analytics section replaced by serving totals, if those can be read."""
    if campaign_performance is None:
        return document
    live = serving_totals(campaign_performance).select(F.struct("headline", "description", "pipelines", "signals"))
    return document.withColumn("analytics", live.scalar())
