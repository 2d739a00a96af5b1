"""The demo tenant, and the export of tables as SQL text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake import fixed_values as fx
from eventlake.functions.formats import sql_bare, sql_literal
from eventlake.functions.text import padded
from eventlake.functions.times import at
from eventlake.plans import seed_values as sv
from eventlake.schemas import APP_TABLES, ENVIRONMENT_TEXTS, TABLES
from eventlake.sources.generators import numbers


def seed_tables(spark: SparkSession, as_of: datetime, members: int = fx.SEED_MEMBERS) -> dict[str, DataFrame]:
    """All app tables of the demo tenant, ages counted back from ``as_of``."""

    def ago(minutes: int | None) -> datetime | None:
        return None if minutes is None else as_of - timedelta(minutes=minutes)

    def frame(name: str, rows: Iterable[tuple]) -> DataFrame:
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in TABLES[name].schema.fields])
        return spark.createDataFrame([(sv.TENANT, *row) for row in rows], schema)

    def counted(rows: Iterable[tuple]) -> list[tuple]:
        return [(*row, position) for position, row in enumerate(rows, start=1)]

    midnight = datetime(as_of.year, as_of.month, as_of.day)
    days = len(sv.DAILY_EVENTS)
    people = sv.FEATURED_SUBSCRIBERS
    featured = frame(
        "platform_subscriber",
        [(p[0], p[1], p[2], p[3], ago(p[4] * 1440), ago(p[5]), p[6], True, n) for n, p in enumerate(people, start=1)],
    )
    return {
        "platform_environment": frame("platform_environment", [(*[sv.ENVIRONMENT[text] for text in ENVIRONMENT_TEXTS], as_of)]),
        "platform_filter": frame("platform_filter", counted((label,) for label in sv.FILTERS)),
        "platform_dashboard_activity": frame(
            "platform_dashboard_activity", counted((*texts, ago(age), tone) for *texts, age, tone in sv.ACTIVITIES)
        ),
        "platform_growth_segment": frame(
            "platform_growth_segment", counted((key, label, Decimal(share)) for key, label, share in sv.GROWTH_SEGMENTS)
        ),
        "platform_campaign": frame("platform_campaign", counted(sv.CAMPAIGNS)),
        "platform_subscriber": featured.unionByName(generated_subscribers(numbers(spark, members), at(as_of))),
        "platform_subscriber_segment": frame(
            "platform_subscriber_segment", [(p[0], label, n) for p in people for n, label in enumerate(p[7], start=1)]
        ),
        "platform_filter_assignment": frame("platform_filter_assignment", [(p[0], tag) for p in people for tag in p[8]]),
        "platform_analytics_pipeline": frame("platform_analytics_pipeline", counted(sv.PIPELINES)),
        "platform_analytics_signal": frame("platform_analytics_signal", counted(sv.SIGNALS)),
        "platform_campaign_analytics": frame(
            "platform_campaign_analytics", [(*row[:5], *map(ago, row[5:])) for row in sv.CAMPAIGN_ANALYTICS]
        ),
        "platform_engagement_analytics": frame(
            "platform_engagement_analytics", counted((*row[:4], *map(ago, row[4:])) for row in sv.ENGAGEMENT_ANALYTICS)
        ),
        "platform_daily_performance": frame(
            "platform_daily_performance",
            [
                ((midnight - timedelta(days=days - 1 - n)).date(), events, ago((days - 1 - n) * 1440 or 4))
                for n, events in enumerate(sv.DAILY_EVENTS)
            ],
        ),
    }


def generated_subscribers(sequence: DataFrame, as_of: Column, tenant: str = sv.TENANT) -> DataFrame:
    """One plain subscriber per ``sequence_id``: state, age and activity follow from the number."""
    n = F.col("sequence_id")
    review = n % fx.SEED_REVIEW_EVERY == 0
    age_days = F.when(n <= fx.SEED_RECENT_MEMBERS, n % 10).otherwise(n % 560 + 35).cast("int")
    idle_hours = (n % 480 + 6).cast("int")
    return sequence.select(
        F.lit(tenant).alias("environment"),
        F.concat(F.lit(fx.SEED_ID_PREFIX), padded(n)).alias("subscriber_id"),
        F.concat(F.lit(fx.SEED_NAME_PREFIX), n.cast("string")).alias("name"),
        F.concat(F.lit(fx.SEED_EMAIL_PREFIX), padded(n), F.lit(fx.SEED_EMAIL_DOMAIN)).alias("email"),
        F.when(review, "Review").otherwise("Encrypted").alias("security_status"),
        (as_of - F.make_dt_interval(days=age_days)).alias("created_at"),
        (as_of - F.make_dt_interval(hours=idle_hours)).alias("last_interaction_at"),
        F.when(review, "tertiary").otherwise("primary").alias("tone"),
        F.lit(False).alias("is_featured"),
        (n + fx.SEED_ORDER_BASE).cast("long").alias("display_order"),
    )


# export

# Tables whose statements update known keys; environment rows are exported without their change time.
UPSERTED = ("platform_campaign_analytics", "platform_engagement_analytics", "platform_daily_performance")
UNEXPORTED = {"platform_environment": ("updated_at",)}


def sql_value(field: T.StructField) -> Column:
    """Numbers bare, everything else quoted, times in UTC with offset, flags as t or f."""
    column = F.col(field.name)
    if isinstance(field.dataType, T.NumericType):
        return sql_bare(column)
    if isinstance(field.dataType, T.TimestampType):
        return sql_literal(F.concat(column.cast("string"), F.lit("+00")))
    if isinstance(field.dataType, T.BooleanType):
        return sql_literal(F.when(column, "t").when(~column, "f"))
    return sql_literal(column)


def insert_statements(name: str, table: DataFrame, schema: str = "analytics") -> DataFrame:
    """One INSERT statement per row."""
    spec = TABLES[name]
    fields = [field for field in spec.schema.fields if field.name not in UNEXPORTED.get(name, ())]
    names = ", ".join(field.name for field in fields)
    ending = ");"
    if name in UPSERTED:
        changes = ", ".join(f"{f.name} = excluded.{f.name}" for f in fields if f.name not in spec.keys)
        ending = f") on conflict ({', '.join(spec.keys)}) do update set {changes};"
    pieces: list[Column] = [F.lit(f"insert into {schema}.{name} ({names}) values (")]
    for position, field in enumerate(fields):
        pieces += [F.lit(", ")] * (position > 0) + [sql_value(field)]
    return table.select(F.concat(*pieces, F.lit(ending)).alias("sql_text"))


def seed_export(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All tables as SQL text in load order."""
    sections = [
        insert_statements(spec.name, tables[spec.name]).withColumn("section_order", F.lit(order))
        for order, spec in enumerate(APP_TABLES, start=1)
        if spec.name in tables
    ]
    return reduce(DataFrame.unionByName, sections).orderBy("section_order", "sql_text").select("section_order", "sql_text")


def write_seed_export(tables: Mapping[str, DataFrame], path: str) -> None:
    """Text files whose names sort in statement order."""
    seed_export(tables).select("sql_text").write.mode("overwrite").text(path)
