from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventlake.functions import formats, json_values, text, times

NOW = "2026-04-09 10:11:12"


@pytest.mark.parametrize("value, want", [(None, "0"), (0, "0"), (950, "950"), (12842, "12,842"), (1234567890123, "1,234,567,890,123")])
def test_integers_are_grouped(one, value, want):
    assert one(formats.format_integer(F.lit(value).cast("long"))) == want


@pytest.mark.parametrize(
    "value, want",
    [(None, "0"), (999, "999"), (1000, "1.0k"), (220300, "220.3k"), (1250, "1.3k"), (999950, "1000.0k"), (1250000, "1.3m"), (2500000000, "2500.0m")],
)
def test_compact_numbers_round_half_up_without_grouping(one, value, want):
    assert one(formats.format_compact(F.lit(value).cast("long"))) == want


@pytest.mark.parametrize("value, want", [("0.25", "0.3%"), ("26.7", "26.7%"), ("36.25", "36.3%"), ("1234.5", "1234.5%"), (None, None)])
def test_percent_rounds_half_up(one, value, want):
    assert one(formats.format_percent(F.lit(value).cast("decimal(10,2)"))) == want


@pytest.mark.parametrize(
    "then, want",
    [
        (None, "No recent activity"),
        ("2026-04-09 10:10:13", "Just now"),
        ("2027-01-01 00:00:00", "Just now"),
        ("2026-04-09 10:10:12", "1 minutes ago"),
        ("2026-04-09 09:11:13", "59 minutes ago"),
        ("2026-04-09 09:11:12", "1 hours ago"),
        ("2026-04-08 10:11:12", "1 days ago"),
        ("2026-04-02 10:11:13", "6 days ago"),
        ("2026-04-02 10:11:12", "Apr 02, 2026"),
    ],
)
def test_relative_time_thresholds_are_strict(one, then, want):
    assert one(formats.relative_time(F.lit(then).cast("timestamp"), times.at(NOW))) == want


def test_sync_label_is_lower_case_throughout(one):
    assert one(formats.last_sync_label(times.at("2026-01-02"), times.at(NOW))) == "Last analytics sync: jan 02, 2026"


def test_literals_are_quoted(one):
    assert one(formats.sql_literal(F.lit("it's"))) == "'it''s'"
    assert one(formats.sql_literal(F.lit("a\\b"))) == "E'a\\\\b'"
    assert one(formats.sql_literal(F.lit(None).cast("string"))) == "NULL"
    assert one(formats.sql_bare(F.lit(None).cast("int"))) == ""


@pytest.mark.parametrize(
    "value, want",
    [("Create Brief", "create-brief"), ("  --A__B!! ", "a-b"), ("", ""), ("Ünïcode x", "n-code-x"), ("\tTab\n", "tab")],
)
def test_slug(one, value, want):
    assert one(text.slug(F.lit(value))) == want


@pytest.mark.parametrize("value, want", [("", "/dashboard"), (" / ", "/dashboard"), (None, "/dashboard"), ("campaigns", "/campaigns"), ("/x", "/x")])
def test_route_path(one, value, want):
    assert one(text.route_path(F.lit(value).cast("string"))) == want


def test_title_keeps_later_capitals(one):
    assert one(text.default_campaign_title(F.lit("createBRIEF"))) == "CreateBRIEF"
    assert one(text.default_campaign_title(F.lit("launch-test.send it's_ok"))) == "Launch Test.Send It'S_ok"
    assert one(text.default_campaign_title(F.lit("  "))) == "Campaign Brief"


def test_ids_and_keys(one):
    assert one(text.generated_id(text.slug(F.lit("create-brief")), times.at(NOW))) == "create-brief-20260409101112"
    assert one(text.key_hash(F.lit("a"), F.lit(None).cast("string"))) is None
    assert one(text.object_topic(F.lit("bronze/email/x.json"))) == "email"
    assert one(text.object_topic(F.lit("bronze"))) == "unknown"
    assert one(text.object_topic(F.lit("silver/email"))) == "unknown"
    assert one(text.padded(F.lit(7))) == "    7"
    assert one(text.padded(F.lit(1234567))) == "1234567"


@pytest.mark.parametrize(
    "subject, metadata, want",
    [
        ("Ann Lee", "{}", "ann-lee"),
        ("new-subscriber", '{"subscriberId":"S 1"}', "s-1"),
        ("", '{"email":"Jo.Do@x.y","name":"Other"}', "jo-do"),
        (" ", '{"email":"@x.y","name":"Jo Do"}', "jo-do"),
        ("", '{"name":5}', "subscriber-20260409101112"),
    ],
)
def test_subscriber_key(one, subject, metadata, want):
    assert one(text.subscriber_key(F.lit(subject), json_values.parsed(F.lit(metadata)), times.at(NOW))) == want


DOCUMENT = '{"s":" x ","n":5.7,"m":-3.2,"b":true,"z":null,"blank":"  ","l":["a"," b ",5,""],"e":[],"deep":{"b":1.50,"a":"x"}}'


def test_json_reads_keep_types(one):
    document = json_values.parsed(F.lit(DOCUMENT))
    for key in ("n", "b", "z", "l", "deep", "absent"):
        assert one(json_values.string_or_empty(document, key)) == ""
    assert one(json_values.string_or_empty(document, "s")) == " x "
    assert one(json_values.text_field(document, "s", F.lit("d"))) == "x"
    assert one(json_values.text_field(document, "blank", F.lit("d"))) == "d"
    assert one(json_values.text_field(document, "n", F.lit("d"))) == "d"
    assert one(json_values.int_field(document, "n", 1)) == 5
    assert one(json_values.int_field(document, "m", 1)) == -3
    assert one(json_values.int_field(document, "s", 1)) == 1
    assert one(json_values.int_field(json_values.parsed(F.lit('{"n":1e300}')), "n", 7, "int")) == 7
    assert one(json_values.strings_field(document, "l", ("D",))) == ["a", "b"]
    assert one(json_values.strings_field(document, "e", ("D",))) == ["D"]
    assert one(json_values.strings_field(document, "s", ("D",))) == ["D"]
    assert one(json_values.string_or_empty(json_values.parsed(F.lit("{broken")), "s")) == ""


def test_canonical_text_sorts_keys(one):
    assert one(json_values.canonical(F.lit('{ "b": {"d":1, "c":2}, "a": [1] }'))) == '{"a":[1],"b":{"c":2,"d":1}}'
    assert one(json_values.canonical(F.lit("nope"))) is None


def test_object_text_keeps_nulls(one):
    assert one(json_values.object_text(a=F.lit(None).cast("string"), b=F.lit(1))) == '{"a":null,"b":1}'


@pytest.mark.parametrize(
    "value, want",
    [
        ("2026-04-09T10:11:12.987Z", datetime(2026, 4, 9, 10, 11, 12)),
        ("2026-04-09T12:11:12+02:00", datetime(2026, 4, 9, 10, 11, 12)),
        ("2026-04-09 garbage", datetime(1970, 1, 1)),
        ("2026-13-45", datetime(1970, 1, 1)),
        ("yesterday", datetime(1970, 1, 1)),
        ("", datetime(1970, 1, 1)),
    ],
)
def test_times_fall_back_to_the_epoch(one, value, want):
    assert one(times.parse_or_epoch(F.lit(value))) == want


def test_search_rules(one):
    title = F.lit("Spring Brief")
    assert one(text.matches_words("  ", title))
    assert one(text.matches_words(" RING br ", title))
    assert not one(text.matches_words("x", title))
    tags = F.array(F.lit("High Value"))
    assert one(text.has_tag(tags, "high VALUE"))
    assert one(text.has_tag(F.lit(None).cast("array<string>"), "All Contacts"))
    assert not one(text.has_tag(tags, "all contacts"))


def test_whole_numbers(one):
    assert [one(text.whole_number(F.lit(v).cast("string"))) for v in ("12", "12.9", "x", None)] == [12, 12, 0, 0]
