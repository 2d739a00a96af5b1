"""Dashboard numbers of the demo tenant, checked against hand-derived values."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from frames import rows
from pyspark.sql import functions as F

from eventlake.functions.times import at
from eventlake.plans import models, views
from eventlake.plans.seed import generated_subscribers, seed_export, seed_tables
from eventlake.sources.generators import numbers

AS_OF = datetime(2026, 4, 9, 10, 11, 12)


@pytest.fixture(scope="module")
def tables(spark):
    return seed_tables(spark, AS_OF)


@pytest.fixture(scope="module")
def document(tables):
    row = views.document_json(views.platform_bootstrap(tables, at(AS_OF), environment="local")).collect()
    assert len(row) == 1 and row[0]["page"] == 0
    return {name: json.loads(row[0][name]) for name in ("brand", "session", "dashboard", "campaigns", "subscribers", "analytics")}


def test_live_metrics_have_null_rates_without_deliveries(tables):
    got = {r["campaign_id"]: r for r in views.campaign_live_metrics(tables["platform_campaign_analytics"]).collect()}
    spring = got["spring-capital-briefing"]
    assert [float(spring[name]) for name in ("open_rate", "click_rate", "deliverability_rate")] == [36.2, 9.3, 99.67]
    assert got["monthly-security-digest"]["open_rate"] is None
    assert got["monthly-security-digest"]["deliverability_rate"] is None


def test_metric_cards(document):
    cards = {card["id"]: card for card in document["dashboard"]["metrics"]}
    assert list(cards) == ["total-subscribers", "avg-open-rate", "click-through-rate"]
    assert cards["total-subscribers"]["value"] == "12,842"
    assert cards["avg-open-rate"]["value"] == "26.7%"
    assert cards["avg-open-rate"]["delta"].startswith("3,020 opens")
    assert cards["click-through-rate"]["value"] == "6.5%"
    assert cards["click-through-rate"]["delta"].startswith("729 clicks")


def test_summary_cards(document):
    reach, engagement, deliverability = document["campaigns"]["stats"]
    assert (reach["value"], reach["detail"]) == ("220.3k", "3 sent campaigns")
    assert (engagement["value"], engagement["detail"]) == ("25.9%", "11,300 deliveries consolidated")
    assert (deliverability["value"], deliverability["detail"], deliverability["progress"]) == ("99.7%", "29 bounced addresses", 100)


def test_bars(document):
    bars = document["dashboard"]["performance"]["bars"]
    assert [bar["height"] for bar in bars] == [50, 80, 72, 60, 86, 94, 46]
    assert [bar["emphasis"] for bar in bars].index(True) == 5
    assert bars[-1]["label"] == "Thu" and bars[0]["value"] == "3.3k"


def test_campaign_entries_show_rates_only_when_sent(document):
    entries = document["campaigns"]["items"]
    assert [e["id"] for e in entries][0] == "spring-capital-briefing"
    assert [e["openRate"] for e in entries] == ["36.2%", "--", "--", "21.5%", "20.0%"]
    assert entries[0]["audience"] == "46,800"


def test_subscriber_section(document):
    section = document["subscribers"]
    assert section["networkSize"] == "12,842"
    assert [e["id"] for e in section["items"]][:2] == ["evelyn-sterling", "marcus-aurelius-ii"]
    assert section["items"][0]["assignedSegments"] == ["VVIP", "Q4 Launch"]
    assert section["items"][0]["filterTags"] == ["High Value", "Newly Verified"]
    assert section["items"][0]["lastInteraction"] == "24 minutes ago"
    assert section["filters"] == ["All Contacts", "High Value", "Inactive", "Newly Verified"]


def test_sync_label_and_overlay(tables, document):
    assert document["brand"]["lastSync"] == "Last analytics sync: just now"
    serving = models.serving_campaign_performance(models.mart_campaign_performance(tables["platform_campaign_analytics"]))
    base = views.platform_bootstrap(tables, at(AS_OF), environment="local")
    live = views.with_live_analytics(base, serving).first()["analytics"]
    assert live["description"] == "Open 3020 • Click 729 • Delivered 11300"
    assert live["signals"] == [] and len(live["pipelines"]) == 1
    assert len(views.with_live_analytics(base, None).first()["analytics"]["signals"]) == 3


def test_serving_totals_of_no_rows(tables):
    none = models.mart_campaign_performance(tables["platform_campaign_analytics"].where("false"))
    assert views.serving_totals(none).first()["description"] == "Open 0 • Click 0 • Delivered 0"


def test_tenant_without_data(tables):
    lonely = dict(tables)
    lonely["platform_environment"] = tables["platform_environment"].withColumn("environment", F.lit("other"))
    metrics = views.dashboard_metrics(lonely["platform_environment"], tables["platform_subscriber"], tables["platform_campaign_analytics"], at(AS_OF))
    assert [r["value"] for r in metrics.orderBy("display_order").collect()] == ["0", "0.0%", "0.0%"]
    assert metrics.orderBy("display_order").first()["delta"] == "+0.0% this month"
    bars = views.dashboard_bars(lonely["platform_environment"], tables["platform_daily_performance"], at(AS_OF)).orderBy("display_order").collect()
    assert [b["height"] for b in bars] == [18] * 7
    assert [b["emphasis"] for b in bars] == [False] * 6 + [True]  # of equal days the later
    section = views.platform_bootstrap(lonely, at(AS_OF), environment="other").first()
    assert section["campaigns"]["items"] == [] and section["subscribers"]["items"] == []
    assert section["subscribers"]["networkSize"] == "0"


def test_generated_subscribers(spark):
    got = {r["display_order"] - 1000: r for r in generated_subscribers(numbers(spark, 1500), at(AS_OF)).collect()}
    assert got[7]["subscriber_id"] == "seed-member-    7"
    assert got[31]["security_status"] == "Review" and got[30]["security_status"] == "Encrypted"
    assert (AS_OF - got[1424]["created_at"]).days == 4 and (AS_OF - got[1425]["created_at"]).days == 35 + 1425 % 560


def test_export_renders_loadable_statements(tables):
    lines = [r["sql_text"] for r in seed_export({**tables, "platform_subscriber": tables["platform_subscriber"].where("is_featured")}).collect()]
    assert len(lines) == 1 + 4 + 4 + 4 + 5 + 6 + 10 + 7 + 3 + 3 + 5 + 4 + 7
    assert lines[0].startswith("insert into analytics.platform_environment (environment, brand_name")
    daily = [line for line in lines if "platform_daily_performance" in line]
    assert daily[-1].endswith(
        "values ('local', '2026-04-09', 2980, '2026-04-09 10:07:12+00') on conflict (environment, bucket_date) "
        "do update set event_count = excluded.event_count, refreshed_at = excluded.refreshed_at;"
    )
    assert any("NULL, NULL, '2026-04-09 09:59:12+00')" in line for line in lines)
    assert any("'t', 1);" in line for line in lines)


def test_staging_keys_are_null_safe(spark, tables):
    engagement = tables["platform_engagement_analytics"].withColumn("event_name", F.lit(None).cast("string"))
    assert {r["event_id"] for r in models.stg_analytics_events(engagement, at(AS_OF)).collect()} == {None}


def test_marts_keep_one_row_per_tenant(tables):
    two = tables["platform_campaign_analytics"].unionByName(
        tables["platform_campaign_analytics"].withColumn("environment", F.lit("other"))
    )
    assert len(rows(models.mart_campaign_performance(two), "campaign_id")) == 10
