from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from frames import rows

from eventlake.plans import commands
from eventlake.plans.seed import seed_tables
from eventlake.schemas import COMMAND

NOW = datetime(2026, 4, 9, 10, 11, 12)


@pytest.fixture(scope="module")
def tables(spark):
    return {name: table.cache() for name, table in seed_tables(spark, NOW, members=20).items()}


def batch(spark, *given):
    data = []
    for n, fields in enumerate(given):
        row = {"command_id": f"c{n}", "environment": "local", "surface": "s", "action": "a", "occurred_at": NOW + timedelta(seconds=n), **fields}
        data.append(tuple(row.get(name) for name in COMMAND.names))
    return spark.createDataFrame(data, COMMAND)


def normalized(spark, **fields):
    return commands.normalize(batch(spark, fields)).first()


def test_campaign_defaults_from_the_subject(spark):
    row = normalized(spark, surface="campaign-row", action="launch-test-send", subject_type="campaign", subject_id="product-unveiling-zenith")
    assert row["session_id"].startswith("session-") and len(row["session_id"]) == 20
    assert row["campaign_id"] == "product-unveiling-zenith"
    assert (row["user_id"], row["route"], row["event_kind"]) == ("platform-operator", "dashboard", "auto")


def test_new_brief_gets_a_generated_campaign(spark, tables):
    given = batch(spark, dict(surface="campaigns-header", action="create-brief", subject_type="campaign", subject_id="new-brief"))
    outcome = commands.process(given, tables)
    result = outcome.results.first()
    assert result["stored"] and result["campaign_id"] == "create-brief-20260409101112"
    assert result["published"] == ["analytics", "email"]
    assert outcome.campaigns.campaigns.first()["campaign_id"] == result["campaign_id"]
    assert '"subject_id":"create-brief-20260409101112"' in outcome.events.where("channel = 'analytics'").first()["payload"]
    assert outcome.campaigns.new_analytics.first()["delivered_recipients"] == 0


def test_brief_without_campaign_subject_still_publishes_email(spark):
    row = commands.fan_out(commands.normalize(batch(spark, dict(action="create-brief", event_kind="auto")))).where("channel = 'email'").first()
    assert row["event_type"] == "ui_create-brief" and row["campaign_id"].startswith("create-brief-")


@pytest.mark.parametrize(
    "fields, channels",
    [
        (dict(event_kind="analytics", subject_type="campaign", subject_id="x"), ["analytics"]),
        (dict(event_kind="email"), ["email"]),
        (dict(event_kind="both"), ["analytics", "email"]),
        (dict(event_kind="auto"), ["analytics"]),
        (dict(event_kind="auto", campaign_id="c"), ["analytics", "email"]),
        (dict(event_kind="odd"), ["analytics"]),
    ],
)
def test_routing(spark, fields, channels):
    events = commands.fan_out(commands.normalize(batch(spark, fields)))
    assert [r["channel"] for r in events.orderBy("channel").collect()] == channels


def test_blank_surface_or_action_is_rejected(spark, tables):
    outcome = commands.process(batch(spark, dict(surface=" \t"), dict(action=None)), tables)
    assert rows(outcome.rejected, "command_id", "reason") == [("c0", "surface is required"), ("c1", "action is required")]
    assert outcome.events.isEmpty() and outcome.results.isEmpty()


def launch(campaign, **more):
    return dict(action="launch-test-send", subject_type="campaign", subject_id=campaign, **more)


def brief(campaign, metadata="{}"):
    return dict(action="create-brief", subject_type="campaign", subject_id=campaign, metadata=metadata)


def test_launch_of_an_unknown_campaign_is_rejected_and_silent(spark, tables):
    outcome = commands.process(batch(spark, launch("nowhere"), launch("product-unveiling-zenith")), tables)
    assert rows(outcome.rejected, "command_id", "reason") == [("c0", "campaign was not found")]
    assert {r["command_id"] for r in outcome.events.collect()} == {"c1"}
    changed = outcome.campaigns.campaigns.first()
    assert (changed["status"], changed["tone"], changed["display_order"]) == ("Scheduled", "primary", 3)
    assert changed["title"] == "Product Unveiling Zenith"


def test_commands_of_one_campaign_apply_in_order(spark, tables):
    given = batch(
        spark, launch("fresh"), brief("fresh", '{"title":"One","audienceCount":7.9}'), launch("fresh"), brief("other"), launch("other"),
        brief("other", '{"title":" Two "}'),
    )
    outcome = commands.process(given, tables)
    assert rows(outcome.rejected, "command_id") == [("c0",)]
    got = {r["campaign_id"]: r for r in outcome.campaigns.campaigns.collect()}
    assert (got["fresh"]["title"], got["fresh"]["status"], got["fresh"]["audience_count"]) == ("One", "Scheduled", 7)
    assert (got["other"]["title"], got["other"]["status"]) == ("Two", "Draft")
    assert [got[name]["display_order"] for name in ("fresh", "other")] == [6, 7]


def test_rewritten_brief_keeps_its_order_number(spark, tables):
    changed = commands.process(batch(spark, brief("quarterly-insight-report")), tables).campaigns.campaigns.first()
    assert (changed["title"], changed["status"], changed["display_order"]) == ("Create Brief", "Draft", 4)


def test_subscriber_adds_fold_into_one_row(spark, tables):
    first = dict(action="add-subscriber", subject_id="new-subscriber", metadata='{"email":"Jo.Do@x.y","filterTags":["Beta","High Value"]}')
    last = dict(action=" add-subscriber ", metadata='{"name":"Jo Do","assignedSegments":["B","A","B","C"],"filterTags":[" ","Alpha"]}')
    known = dict(action="add-subscriber", subject_id="evelyn-sterling")
    outcome = commands.process(batch(spark, first, last, known), tables).subscribers
    got = {r["subscriber_id"]: r for r in outcome.subscribers.collect()}
    assert (got["jo-do"]["name"], got["jo-do"]["email"]) == ("Jo Do", "jo-do@curator.local")
    assert got["jo-do"]["created_at"] == NOW and got["jo-do"]["last_interaction_at"] == NOW + timedelta(seconds=1)
    assert got["jo-do"]["display_order"] == 1021 and got["jo-do"]["is_featured"]
    assert got["evelyn-sterling"]["display_order"] == 1 and got["evelyn-sterling"]["created_at"] == NOW - timedelta(days=12)
    assert rows(outcome.segments.where("subscriber_id = 'jo-do'"), "segment_label", "display_order") == [("A", 2), ("B", 1), ("C", 4)]
    assert rows(outcome.assignments.where("subscriber_id = 'jo-do'"), "filter_label") == [("Alpha",)]
    assert rows(outcome.filters, "filter_label", "display_order") == [("Alpha", 6), ("Beta", 5)]


def test_other_actions_change_nothing(spark, tables):
    outcome = commands.process(batch(spark, dict(action="navigate")), tables)
    assert not outcome.results.first()["stored"]
    assert outcome.campaigns.campaigns.isEmpty() and outcome.subscribers.subscribers.isEmpty()
