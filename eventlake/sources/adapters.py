"""Platform-shaped frames derived from the given star-schema and event tables.

Each frame covers the whole of its source table. Tenants are ``env0`` .. ``env4``
(one per region); data falls into the first three, so two tenants stay empty.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.times import at, iso_micros
from eventlake.plans.consolidate import consolidate_campaign, consolidate_daily, consolidate_engagement
from eventlake.schemas import ENVIRONMENT_TEXTS

EVENTS_AS_OF = "2024-01-31 00:00:00"
SUBSCRIBERS_AS_OF = "1996-01-15 00:00:00"
LABELS_AS_OF = "2001-08-01 12:00:00"
START = "2024-01-01 00:00:00"


def tenant(number: Column) -> Column:
    return F.concat(F.lit("env"), number.cast("string"))


def named(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def event_columns(events: DataFrame) -> DataFrame:
    """Typed columns of the event table, for batch and streaming frames alike."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("event_number"),
        named("evt-", F.col("event_id")).alias("event_id"),
        tenant(F.col("user_id") % 3).alias("environment"),
        named("cmp-", F.col("user_id")).alias("campaign_id"),
        named("user-", F.col("user_id")).alias("user_id"),
        named("rcp-", k).alias("recipient_id"),
        named("/p", k % 10).alias("page_url"),
        F.col("event_type").alias("event_name"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        (k % 10).cast("int").alias("page_number"),
        F.col("user_id").alias("user_number"),
        k.alias("k"),
    )


def raw_payload_text(event: DataFrame) -> DataFrame:
    """Events as raw messages (topic, key, value) with every defect a parser has to stand.

    By event number: the name sits in ``event``, ``event_name``, ``event_type`` or is a number;
    some messages are cut short and some carry an unreadable time.
    """
    number = F.col("event_number")
    when_text = (
        F.when(number % 50 == 9, "not a time").when(number % 50 == 11, "2024-13-45 bad").otherwise(iso_micros(F.col("occurred_at")))
    )
    name_field = (
        F.when(number % 4 == 0, F.concat(F.lit('"event":"'), F.col("event_name"), F.lit('",')))
        .when(number % 4 == 1, F.concat(F.lit('"event_name":"'), F.col("event_name"), F.lit('",')))
        .when(number % 4 == 2, F.concat(F.lit('"event_type":"'), F.col("event_name"), F.lit('",')))
        .otherwise(F.concat(F.lit('"event":5,"event_name":"'), F.col("event_name"), F.lit('","campaign_id":null,')))
    )
    campaign_field = F.when(
        number % 4 != 3, F.concat(F.lit('"campaign_id":"'), F.col("campaign_id"), F.lit('",'))
    ).otherwise("")
    body = F.concat(
        F.lit('{"event_id":"'), F.when(number % 50 == 13, "").otherwise(F.col("event_id")), F.lit('",'),
        name_field, campaign_field,
        F.lit('"user_id":"'), F.col("user_id"),
        F.lit('","page_url":"'), F.col("page_url"),
        F.lit('","occurred_at":"'), when_text,
        F.lit('","payload":{"k":'), F.col("k").cast("string"), F.lit("}"),
    )
    topic = F.when(number % 4 == 2, fx.EMAIL_TOPIC).otherwise(fx.ANALYTICS_TOPIC)
    return event.select(
        topic.alias("topic"),
        F.when(number % 4 == 2, F.col("campaign_id")).otherwise(F.col("user_id")).alias("key"),
        F.when(number % 50 == 7, body).otherwise(F.concat(body, F.lit("}"))).alias("value"),
        F.col("occurred_at").alias("timestamp"),
        "event_number",
    )


class Frames:
    """Lazily derived frames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return event_columns(self.table("events"))

    @cached_property
    def email_events(self) -> DataFrame:
        name = F.col("event_name")
        return self.events.select(
            "environment", "campaign_id", "recipient_id", "occurred_at",
            (name != "error").alias("is_delivered"),
            name.isin("view", "click", "purchase").alias("is_open"),
            name.isin("click", "purchase").alias("is_click"),
            (name == "error").alias("is_bounce"),
        )

    @cached_property
    def page_events(self) -> DataFrame:
        return self.events.select("environment", "page_url", "event_name", "user_id", "occurred_at")

    # consolidated tables

    @cached_property
    def campaign_analytics(self) -> DataFrame:
        return consolidate_campaign(self.email_events, at(EVENTS_AS_OF))

    @cached_property
    def engagement_analytics(self) -> DataFrame:
        return consolidate_engagement(self.page_events, at(EVENTS_AS_OF))

    @cached_property
    def daily_performance(self) -> DataFrame:
        return consolidate_daily(self.page_events, at(EVENTS_AS_OF))

    # reference content

    @cached_property
    def environment(self) -> DataFrame:
        texts = [F.concat(F.col("r_name"), F.lit(f" {text}")).alias(text) for text in ENVIRONMENT_TEXTS]
        return self.table("region").select(
            tenant(F.col("r_regionkey")).alias("environment"), *texts, at(START).alias("updated_at")
        )

    @cached_property
    def campaign(self) -> DataFrame:
        status = F.get(F.array(F.lit("Sent"), F.lit("Scheduled"), F.lit("Draft")), F.expr("p_partkey div 3 % 3").cast("int"))
        return self.table("part").select(
            tenant(F.col("p_partkey") % 3).alias("environment"),
            named("cmp-", F.col("p_partkey")).alias("campaign_id"),
            F.col("p_name").alias("title"),
            F.concat_ws(" ", "p_brand", "p_type").alias("summary"),
            status.alias("status"),
            (F.col("p_size") * 1000).alias("audience_count"),
            F.col("p_brand").alias("audience_label"),
            F.col("p_type").alias("action_label"),
            F.lit("primary").alias("tone"),
            (F.col("p_partkey") + 1).cast("long").alias("display_order"),
        )

    @cached_property
    def subscriber(self) -> DataFrame:
        order_span = (
            self.table("orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.min("o_orderdate").cast("timestamp").alias("first_order"), F.max("o_orderdate").cast("timestamp").alias("last_order"))
        )
        return (
            self.table("customer")
            .join(order_span, "c_custkey", "left")
            .select(
                tenant(F.col("c_custkey") % 3).alias("environment"),
                named("sub-", F.col("c_custkey")).alias("subscriber_id"),
                F.col("c_name").alias("name"),
                F.concat(F.lower(F.col("c_name")), F.lit("@example.com")).alias("email"),
                F.col("c_mktsegment").alias("security_status"),
                F.coalesce("first_order", F.lit("1995-01-01").cast("timestamp")).alias("created_at"),
                F.col("last_order").alias("last_interaction_at"),
                F.lit("primary").alias("tone"),
                (F.col("c_custkey") % 10 == 0).alias("is_featured"),
                (F.col("c_custkey") + 1).cast("long").alias("display_order"),
            )
        )

    @cached_property
    def subscriber_segment(self) -> DataFrame:
        return (
            self.table("orders")
            .select("o_custkey", "o_orderpriority")
            .distinct()
            .select(
                tenant(F.col("o_custkey") % 3).alias("environment"),
                named("sub-", F.col("o_custkey")).alias("subscriber_id"),
                F.col("o_orderpriority").alias("segment_label"),
                F.substring("o_orderpriority", 1, 1).cast("long").alias("display_order"),
            )
        )

    @cached_property
    def filter_assignment(self) -> DataFrame:
        return (
            self.table("orders")
            .select("o_custkey", "o_orderstatus")
            .distinct()
            .select(
                tenant(F.col("o_custkey") % 3).alias("environment"),
                named("sub-", F.col("o_custkey")).alias("subscriber_id"),
                F.col("o_orderstatus").alias("filter_label"),
            )
        )

    @cached_property
    def filter(self) -> DataFrame:
        return (
            self.table("orders")
            .select(
                tenant(F.col("o_custkey") % 3).alias("environment"),
                F.col("o_orderstatus").alias("filter_label"),
            )
            .distinct()
            .select("environment", "filter_label", F.instr(F.lit("POF"), F.col("filter_label")).alias("display_order"))
        )

    @cached_property
    def activity(self) -> DataFrame:
        hours = F.make_dt_interval(hours=F.col("n_nationkey") * 7)
        return self.table("nation").select(
            tenant(F.col("n_regionkey")).alias("environment"),
            named("act-", F.col("n_nationkey")).alias("activity_id"),
            F.col("n_name").alias("title"),
            F.concat(F.lit("Activity in "), F.col("n_name")).alias("description"),
            (at(LABELS_AS_OF) - hours).alias("occurred_at"),
            F.lit("muted").alias("tone"),
            (F.col("n_nationkey") + 1).cast("long").alias("display_order"),
        )

    @cached_property
    def growth_segment(self) -> DataFrame:
        cents = F.abs(F.round(F.col("s_acctbal") * 100)).cast("long")
        return self.table("supplier").select(
            tenant(F.col("s_suppkey") % 3).alias("environment"),
            named("seg-", F.col("s_suppkey")).alias("segment_id"),
            F.col("s_name").alias("label"),
            ((cents % 10000).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(5,2)").alias("percentage"),
            (F.col("s_suppkey") + 1).cast("long").alias("display_order"),
        )

    @cached_property
    def pipeline(self) -> DataFrame:
        return self.table("nation").select(
            tenant(F.col("n_regionkey")).alias("environment"),
            named("pipe-", F.col("n_nationkey")).alias("pipeline_id"),
            F.col("n_name").alias("title"),
            F.concat(F.lit("Pipeline of "), F.col("n_name")).alias("description"),
            F.lit("Live").alias("status"),
            (F.col("n_nationkey") + 1).cast("long").alias("display_order"),
        )

    @cached_property
    def signal(self) -> DataFrame:
        return self.table("nation").select(
            tenant(F.col("n_regionkey")).alias("environment"),
            named("sig-", F.col("n_nationkey")).alias("signal_id"),
            F.col("n_name").alias("title"),
            F.concat(F.lit("Signal of "), F.col("n_name")).alias("description"),
            F.lit("open-analytics-view").alias("action"),
            F.lit("analytics").alias("event_kind"),
            F.lit("navigation").alias("subject_type"),
            F.col("n_name").alias("subject_id"),
            (F.col("n_nationkey") + 1).cast("long").alias("display_order"),
        )

    # messages and logs

    @cached_property
    def raw_messages(self) -> DataFrame:
        return raw_payload_text(self.events)

    @cached_property
    def partner_records(self) -> DataFrame:
        """Partner records; every record id comes twice."""
        s = F.col("s_suppkey")
        minutes = F.make_dt_interval(mins=s.cast("int"))
        cents = F.round(F.col("s_acctbal") * 100).cast("long")
        return self.table("supplier").select(
            named("rec-", F.floor(s / 2)).alias("record_id"),
            F.when(F.col("s_nationkey") % 2 == 0, "ads_partner").otherwise("crm_partner").alias("provider"),
            F.when(F.col("s_nationkey") % 5 != 0, named("acct-", F.col("s_nationkey"))).otherwise("").alias("account_id"),
            iso_micros(at(START) + minutes).alias("collected_at"),
            F.concat(F.lit('{"spend_cents":'), cents.cast("string"), F.lit(',"nation":'), F.col("s_nationkey").cast("string"), F.lit("}")).alias("payload"),
        )

    @cached_property
    def known_partner_records(self) -> DataFrame:
        """Records that an earlier load already stored."""
        s = F.col("s_suppkey")
        return self.table("supplier").where(F.floor(s / 2) % 3 == 0).select(
            named("rec-", F.floor(s / 2)).alias("record_id"),
            F.lit("ads_partner").alias("provider"),
            F.lit("stored").alias("account_id"),
            F.lit("2023-12-31").cast("timestamp").alias("collected_at"),
            F.lit("{}").alias("payload"),
        ).dropDuplicates(["record_id"])

    @cached_property
    def object_listing(self) -> DataFrame:
        page = F.col("page_id")
        topic = F.when(page % 2 == 0, fx.EMAIL_TOPIC).otherwise(fx.ANALYTICS_TOPIC)
        name = F.when(page % 7 == 0, "").otherwise(F.concat(page.cast("string"), F.lit(".json")))
        return self.table("pages").select(
            F.concat(F.lit("bronze/"), topic, F.lit("/captured_at="), (page + 1704067200).cast("string"), F.lit("/"), name).alias("object_key"),
            F.md5("html").alias("etag"),
            F.timestamp_seconds(page + 1704067200).alias("last_modified"),
            F.octet_length("html").cast("long").alias("size"),
        )

    @cached_property
    def indexed_keys(self) -> DataFrame:
        """Keys a former sync has stored: those of every third second."""
        captured = F.regexp_extract("object_key", "captured_at=([0-9]+)/", 1).cast("long")
        return self.object_listing.where(captured % 3 == 0).select("object_key")

    @cached_property
    def commands(self) -> DataFrame:
        n, k, user = F.col("event_number"), F.col("k"), F.col("user_number").cast("string")
        name = F.col("event_name")
        action = (
            F.when(name == "signup", fx.ADD_SUBSCRIBER).when(name == "purchase", fx.CREATE_BRIEF)
            .when(name == "click", fx.LAUNCH_TEST_SEND).when(name == "view", "open-analytics-view").otherwise("Navigate To!")
        )
        subject_id = (
            F.when((name == "purchase") & (n % 3 == 0), "new-brief")
            .when((name == "click") & (n % 6 == 0), F.concat(F.lit("gone-"), user))
            .when((name == "signup") & (n % 2 == 0), fx.SUBSCRIBER_PLACEHOLDER)
            .when((name == "signup") & (n % 4 == 1), F.concat(F.lit("Member "), user))
            .when(name == "signup", F.concat(F.lit("sub-"), user))
            .when(name.isin("purchase", "click"), F.concat(F.lit("cmp-"), user))
            .otherwise("analytics")
        )
        metadata = (
            F.when(name == "purchase", F.concat(F.lit('{"title":" Brief '), k.cast("string"), F.lit('","audienceCount":'), (k * 10).cast("string"), F.lit(',"tone":5}')))
            .when(name == "signup", F.concat(
                F.lit('{"email":"Member.'), user, F.lit('@mail.org","assignedSegments":["S'), (k % 5).cast("string"),
                F.lit('"," Core ","S'), (k % 5).cast("string"), F.lit('"],"filterTags":["Tag '), (k % 7).cast("string"), F.lit('","",4]}'),
            ))
            .when(n % 4 == 0, F.lit("not json"))
        )
        return self.events.select(
            F.col("event_id").alias("command_id"),
            "environment",
            F.when(n % 5 != 0, F.concat(F.lit("s-"), user)).alias("session_id"),
            F.when(n % 7 == 0, "").otherwise(F.col("user_id")).alias("user_id"),
            F.get(F.array(F.lit(""), F.lit("/"), F.lit("campaigns"), F.lit("/subscribers")), (k % 4).cast("int")).alias("route"),
            F.when(n % 41 == 0, " ").otherwise("Campaign Row").alias("surface"),
            action.alias("action"),
            F.when(name.isin("purchase", "click"), "campaign").when(name == "signup", "subscriber").otherwise("navigation").alias("subject_type"),
            subject_id.alias("subject_id"),
            F.when((n % 10 == 0) & name.isin("view", "error"), F.col("campaign_id")).otherwise("").alias("campaign_id"),
            "recipient_id",
            F.get(F.array(F.lit(None).cast("string"), F.lit("auto"), F.lit("analytics"), F.lit("email"), F.lit("both")), (n % 5).cast("int")).alias("event_kind"),
            metadata.alias("metadata"),
            "occurred_at",
        )

    @cached_property
    def request_log(self) -> DataFrame:
        return request_log_columns(self.events)

    @cached_property
    def run_log(self) -> DataFrame:
        return self.table("orders").select(
            named("run-", F.col("o_orderkey")).alias("run_id"),
            F.col("o_orderpriority").alias("op_name"),
            F.when(F.col("o_orderstatus") == "F", "error").otherwise("success").alias("status"),
            (F.floor(F.col("o_totalprice")) % 120000).cast("double").alias("duration_ms"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
        )

    @cached_property
    def request_samples(self) -> DataFrame:
        """Request counters: climbing by event number, back to zero every 1,000 events."""
        log = self.events
        return log.select(
            F.lit("app_http_requests_total").alias("metric"),
            F.create_map(
                F.lit("service"), service(), F.lit("route"), F.col("page_url"), F.lit("status"), status().cast("string")
            ).alias("labels"),
            F.col("occurred_at").alias("ts"),
            (F.col("event_number") % 1000).cast("double").alias("value"),
        )

    @cached_property
    def duration_samples(self) -> DataFrame:
        """Cumulative histogram counters: one sample per bucket bound and event."""
        # bound text and share of observations at or below it, in percent
        bounds = [("0.05", 10), ("0.1", 30), ("0.25", 60), ("0.5", 85), ("1", 95), ("+Inf", 100)]
        log = self.events.withColumn(
            "bound", F.explode(F.array(*[F.struct(F.lit(le).alias("le"), F.lit(share).alias("share")) for le, share in bounds]))
        )
        return log.select(
            F.lit("app_http_request_duration_seconds_bucket").alias("metric"),
            F.create_map(F.lit("service"), service(), F.lit("le"), F.col("bound.le")).alias("labels"),
            F.col("occurred_at").alias("ts"),
            F.floor((F.col("event_number") % 1000) * F.col("bound.share") / 100).cast("double").alias("value"),
        )

    @cached_property
    def up_samples(self) -> DataFrame:
        """Health gauge per job: 0 while the event is an error or a click."""
        return self.events.select(
            F.lit("up").alias("metric"),
            F.create_map(F.lit("job"), service()).alias("labels"),
            F.col("occurred_at").alias("ts"),
            F.when(F.col("event_name").isin("error", "click"), 0.0).otherwise(1.0).alias("value"),
        )


def service() -> Column:
    return named("svc", F.col("user_number") % 3)


def status() -> Column:
    name = F.col("event_name")
    return F.when(name == "error", 500).when(name == "click", 404).otherwise(200)


def request_log_columns(events: DataFrame) -> DataFrame:
    """Request log rows, for batch and streaming frames alike."""
    return events.select(
        service().alias("service"),
        F.lit("GET").alias("method"),
        F.col("page_url").alias("route"),
        status().alias("status"),
        F.col("occurred_at").alias("ts"),
        F.col("event_number").alias("request_id"),
    )
