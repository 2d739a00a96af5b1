from __future__ import annotations

import hashlib
import json
from datetime import date, datetime
from pathlib import Path

import pytest
from frames import rows
from pyspark.sql import functions as F

from eventlake.functions.times import at
from eventlake.plans import audit, jobs
from eventlake.plans.seed import seed_tables, write_seed_export
from eventlake.schemas import COMMAND, REQUIRED_COLUMNS
from eventlake.session import scratch_dir
from eventlake.sources import bronze, partner
from eventlake.sources.store import TableStore, model_schema

NOW = datetime(2026, 4, 9, 10, 11, 12)


@pytest.fixture
def store(spark):
    return TableStore(spark, scratch_dir(spark, "test-store"))


def daily(spark, *data):
    frame = spark.createDataFrame([(*row, NOW) for row in data], "environment string, bucket_date date, event_count long, refreshed_at timestamp")
    return frame


def counts(store):
    return rows(store.read("platform_daily_performance"), "environment", F.day("bucket_date"), "event_count")


def test_missing_tables_are_created_empty(store):
    jobs.bootstrap_tables(store, ["platform_campaign", "raw_events", "raw_object_index"])
    assert store.read("platform_campaign").isEmpty()
    assert store.read("raw_events").columns == ["event_name", "campaign_id", "user_id", "occurred_at", "payload"]


def test_upsert_inserts_updates_and_is_repeatable(spark, store):
    store.upsert("platform_daily_performance", daily(spark, ("a", date(2026, 1, 1), 1), ("b", date(2026, 1, 1), 2)), ["event_count"])
    change = daily(spark, ("a", date(2026, 1, 1), 10), ("a", date(2026, 1, 2), 3), ("c", date(2026, 1, 1), 4))
    for _ in range(2):
        store.upsert("platform_daily_performance", change, ["event_count"])
        assert counts(store) == [("a", 1, 10), ("a", 2, 3), ("b", 1, 2), ("c", 1, 4)]


def test_upsert_sets_only_named_columns_and_last_wins(spark, store):
    base = "environment string, campaign_id string, title string, summary string, status string, audience_count int, audience_label string, action_label string, tone string, display_order int"
    row = ("e", "c", "old", "s", "Draft", 1, "l", "a", "t", 5)
    store.replace("platform_campaign", spark.createDataFrame([row], base))
    changes = spark.createDataFrame([("e", "c", "new", "s", "Sent", 1, "l", "a", "t", 9), ("e", "c", "newest", "s", "Sent", 1, "l", "a", "t", 10)], base)
    store.upsert("platform_campaign", changes, ["title"], order=["display_order"])
    assert rows(store.read("platform_campaign"), "title", "status", "display_order") == [("newest", "Draft", 5)]


def test_untouched_files_stay(spark, store):
    """Files of other cells stay, and files of the same cell that hold none of the keys."""
    name = "platform_daily_performance"
    for tenant in "ab":
        store.append(name, daily(spark, (tenant, date(2026, 1, 1), 1), (tenant, date(2026, 1, 2), 2)))
    before = set(store.files(name))
    store.upsert(name, daily(spark, ("a", date(2026, 1, 1), 7)), ["event_count"])
    gone = before - set(store.files(name))
    assert len(before) == 4 and len(gone) == 1 and counts(store) == [("a", 1, 7), ("a", 2, 2), ("b", 1, 1), ("b", 2, 2)]


def test_a_crash_before_the_switch_changes_nothing(spark, store, monkeypatch):
    name = "platform_daily_performance"
    store.replace(name, daily(spark, ("a", date(2026, 1, 1), 1), ("b", date(2026, 1, 1), 2)))

    def crash(*_):
        raise RuntimeError("writer died")

    changes = [
        lambda: store.upsert(name, daily(spark, ("a", date(2026, 1, 1), 7)), ["event_count"]),
        lambda: store.reload_tenant(name, "a", daily(spark)),
        lambda: store.append(name, daily(spark, ("c", date(2026, 1, 1), 3)), ("stream", 0)),
        lambda: store.replace(name, daily(spark)),
    ]
    with monkeypatch.context() as patched:
        patched.setattr(TableStore, "_switch", crash)
        for change in changes:
            with pytest.raises(RuntimeError):
                change()
            assert counts(store) == [("a", 1, 1), ("b", 1, 2)]
    assert store.clean(name) > 0 and counts(store) == [("a", 1, 1), ("b", 1, 2)]
    changes[2]()
    changes[0]()
    changes[2]()  # the batch was added once, whatever became of its files
    assert counts(store) == [("a", 1, 7), ("b", 1, 2), ("c", 1, 3)]


def test_a_change_is_evaluated_once(spark, store):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    change = daily(spark, ("a", date(2026, 1, 1), 7), ("b", date(2026, 1, 2), 8))
    store.upsert("platform_daily_performance", change.mapInArrow(count, change.schema), ["event_count"])
    assert seen.value == 2 and counts(store) == [("a", 1, 7), ("b", 2, 8)]


def test_compaction_and_cleaning(spark, store):
    name = "platform_daily_performance"
    for n in range(1, 8):
        store.append(name, daily(spark, ("a", date(2026, 1, 1), n), ("b", date(2026, 1, n + 1), n)), ("counts", n))
    want = counts(store)
    store.compact(name, most_files=3)
    assert counts(store) == want and len(store.files(name, ["2026-01-01"])) <= 3 and len(store.files(name)) < 14
    assert store.clean(name) == 7 and counts(store) == want
    store.append(name, daily(spark, ("z", date(2026, 1, 1), 1)), ("counts", 7))
    assert counts(store) == want


def test_many_tenants_have_few_folders(spark, store):
    name = "platform_subscriber_segment"
    frame = spark.range(3000).selectExpr("concat('t', id % 500) environment", "concat('s', id) subscriber_id", "'x' segment_label", "id display_order")
    store.replace(name, frame)
    assert len({file.split("/")[1] for file in store.files(name)}) <= 16
    store.reload_tenant(name, "t7", frame.limit(0))
    assert store.read(name).count() == 3000 - 6


def test_insert_absent_takes_the_first_and_is_repeatable(spark, store):
    given = spark.createDataFrame(
        [("r1", "p", "later", datetime(2026, 1, 2), "{}"), ("r1", "p", "first", datetime(2026, 1, 1), "{}"), ("r2", "p", None, datetime(2026, 1, 1), "{}")],
        "record_id string, provider string, account_id string, collected_at timestamp, payload string",
    )
    for _ in range(2):
        store.insert_absent("raw_third_party_records", given, ["collected_at", "account_id"])
        assert rows(store.read("raw_third_party_records"), "record_id", "account_id") == [("r1", "first"), ("r2", None)]


def test_update_must_match_reports_misses(spark, store):
    store.replace("platform_filter", spark.createDataFrame([("e", "x", 1)], "environment string, filter_label string, display_order int"))
    missed = store.update_matching("platform_filter", spark.createDataFrame([("e", "x"), ("e", "y")], "environment string, filter_label string"), {"display_order": F.lit(8)})
    assert rows(store.read("platform_filter"), "filter_label", "display_order") == [("x", 8)]
    assert rows(missed, "filter_label") == [("y",)]


def test_replace_children_can_empty_a_partition(spark, store):
    schema = "environment string, subscriber_id string, filter_label string"
    store.replace("platform_filter_assignment", spark.createDataFrame([("e", "s1", "x"), ("e", "s1", "y"), ("e", "s2", "x")], schema))
    parents = spark.createDataFrame([("e", "s1")], "environment string, subscriber_id string")
    store.replace_children("platform_filter_assignment", parents, spark.createDataFrame([("e", "s1", "z")], schema), ["environment", "subscriber_id"])
    assert rows(store.read("platform_filter_assignment")) == [("e", "s1", "z"), ("e", "s2", "x")]
    store.replace_children("platform_filter_assignment", parents, spark.createDataFrame([], schema), ["environment", "subscriber_id"])
    assert rows(store.read("platform_filter_assignment")) == [("e", "s2", "x")]


def test_tenant_reload_leaves_other_tenants(spark, store):
    store.replace("platform_daily_performance", daily(spark, ("a", date(2026, 1, 1), 1), ("b", date(2026, 1, 1), 2)))
    store.reload_tenant("platform_daily_performance", "a", daily(spark, ("a", date(2026, 1, 3), 9)))
    assert counts(store) == [("a", 3, 9), ("b", 1, 2)]
    store.reload_tenant("platform_daily_performance", "a", daily(spark))
    assert counts(store) == [("b", 1, 2)]


def test_replace_switches_versions(spark, store):
    schema = "payload string"
    store.replace("raw_payload", spark.createDataFrame([("one",)], schema))
    before = store.read("raw_payload")
    # a new version may be computed from the old one
    store.replace("raw_payload", before.unionByName(spark.createDataFrame([("two",)], schema)))
    assert rows(before) == [("one",)]
    assert rows(store.read("raw_payload")) == [("one",), ("two",)]


def test_scan_resolves_catalog_names(spark, store):
    spark.range(3).createOrReplaceTempView("listed")
    spark.sql("create database if not exists lake_test")
    spark.range(2).write.mode("overwrite").option("path", scratch_dir(spark, "catalog")).saveAsTable("lake_test.numbers")
    resolved = TableStore(spark, store.root, catalogs={"serving": "lake_test"})
    assert resolved.scan("serving.numbers").count() == 2
    assert rows(audit.catalog_columns(spark, ["numbers", "absent"], "lake_test")) == [("numbers", "id")]
    assert model_schema(None, "base") == "base" and model_schema(" mine ", "base") == "mine"


def snapshot(tmp_path, name, records):
    (tmp_path / name).write_text(records)


def test_daily_job_twice(spark, store, tmp_path):
    folder = tmp_path / "snapshots"
    folder.mkdir()
    (folder / "one.json").write_text(
        '[{"record_id":"1","provider":"ads_partner","account_id":"acct-001","collected_at":"2026-04-09T01:02:03.456789+00:00","payload":{"spend":1.5,"clicks":2}},'
        '{"record_id":"2","provider":"crm_partner","account_id":"","collected_at":"2026-04-09T03:02:03+02:00"}]'
    )
    jobs.load_seed(store, NOW, members=20)
    assert store.read("platform_subscriber").count() == 26
    for run in ("r1", "r2"):
        jobs.refresh_batch_and_serving(store, str(folder), NOW, run)
        log = store.read("third_party_snapshots")
        assert rows(log, "record_id", "account_id", "payload") == [("1", "acct-001", '{"clicks":2,"spend":1.5}'), ("2", None, "{}")]
        assert log.where("record_id = '1'").first()["collected_at"] == datetime(2026, 4, 9, 1, 2, 3, 456000)
        assert log.first()["object_key"] == "lakehouse/ingress/third_party/captured_at=20260409T101112Z/snapshot.json"
        assert store.read("raw_third_party_records").count() == 2
        assert store.read("campaign_performance").count() == 5
        assert store.read("product_engagement").count() == 4
    assert spark.table("stg_email_events").count() == 5
    audited = rows(store.read("load_audit").where("run_id = 'r2'"), "dataset", "rows")
    assert audited == [("campaign_performance", 5), ("product_engagement", 4), ("raw_third_party_records", 2)]


def test_array_files_feed_many_tasks(spark, tmp_path):
    """Items with commas, brackets, quotes and escapes inside strings, over file blocks of a few bytes."""
    items = [{"record_id": str(n), "provider": 'a,"b]}[{\\', "account_id": None, "collected_at": "2026-04-09T01:02:03Z", "payload": {"x": [n, {"y": '],["é' * (n % 7)}], "z": {}}} for n in range(200)]
    texts = [json.dumps(items[:150]), json.dumps(items[150:199], indent=1, ensure_ascii=False), "[]", " [ ] \n", "\n[\n" + json.dumps(items[199]) + "\n]\n"]
    for n, text in enumerate(texts):
        (tmp_path / f"{n}.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        found = partner.array_items(spark, str(tmp_path))
        assert sorted((json.loads(row["item"]) for row in found.collect()), key=lambda item: int(item["record_id"])) == items
        pieces = spark.read.option("lineSep", ",").text(f"{tmp_path}/0.json")
        assert pieces.rdd.getNumPartitions() > 10
        records = partner.snapshot_records(spark, str(tmp_path))
        assert rows(records.select(F.col("record_id").cast("int"), "provider")) == rows(spark.createDataFrame([(int(item["record_id"]), item["provider"]) for item in items], "a int, b string"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_daily_job_takes_lines(spark, store, tmp_path):
    (tmp_path / "one.json").write_text('{"record_id":"1","provider":"p","collected_at":"2026-04-09T01:02:03Z","payload":{"a":1}}\n{"record_id":"2","provider":"p"}\n')
    jobs.ingest_partner_snapshot(store, partner.snapshot_records(spark, str(tmp_path), array=False), NOW)
    assert rows(store.read("third_party_snapshots"), "record_id", "payload") == [("1", '{"a":1}'), ("2", "{}")]


def test_listing_reads_no_content(spark, tmp_path):
    folder = tmp_path / "bronze" / "email_events_raw"
    folder.mkdir(parents=True)
    for name, text in (("a [1].json", "x" * 40), ("b{2}*.json", "y"), ("c.json", "1\n2\n3\n")):
        (folder / name).write_text(text)
    listing = bronze.object_listing(spark, str(tmp_path / "bronze"))
    scan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in scan and listing.count() == 3
    whole = {row["object_key"].split("/")[-1]: row["etag"] for row in bronze.with_etags(listing).collect()}
    assert whole == {name: hashlib.md5((folder / name).read_bytes()).hexdigest() for name in ("a [1].json", "b{2}*.json", "c.json")}
    pieces = {row["object_key"].split("/")[-1]: row["etag"] for row in bronze.with_etags(listing, whole_bytes=5).collect()}
    assert pieces["b{2}*.json"] == whole["b{2}*.json"] and pieces["c.json"].startswith("lines-") and pieces["a [1].json"].startswith("lines-")
    one = listing.where("size = 1")
    assert [row["etag"] for row in bronze.with_etags(one).collect()] == [whole["b{2}*.json"]]


def test_object_index_twice(spark, store, tmp_path):
    folder = tmp_path / "bronze" / "email_events_raw" / "captured_at=1"
    folder.mkdir(parents=True)
    (folder / "a b.json").write_text("{}")
    for objects in (1, 1):
        jobs.sync_object_metadata(store, str(tmp_path / "bronze"), NOW, "run", at_once=1)
        assert store.read("raw_object_index").count() == objects
    (folder / "c.json").write_text("{}{}")
    jobs.sync_object_metadata(store, str(tmp_path / "bronze"), NOW, "run", at_once=1)
    index = store.read("raw_object_index")
    assert rows(index, "object_key", "source_topic", "size") == [
        ("bronze/email_events_raw/captured_at=1/a b.json", "email_events_raw", 2),
        ("bronze/email_events_raw/captured_at=1/c.json", "email_events_raw", 4),
    ]


def test_seed_texts(spark):
    tables = seed_tables(spark, NOW, members=1)
    campaigns = {row["campaign_id"]: (row["title"], row["summary"]) for row in tables["platform_campaign"].collect()}
    assert campaigns["product-unveiling-zenith"] == ("Product Unveiling: Zenith", "Last edited 2 hours ago")
    assert tables["platform_environment"].first()["billing_date"] == "May 24, 2026"
    assert [row["title"] for row in tables["platform_analytics_signal"].collect()] == ["Open analytics view", "Create new brief", "Launch a test send"]


def test_apply_commands_to_the_store(spark, store):
    seeded = seed_tables(spark, NOW, members=20)
    for name in ("campaign", "campaign_analytics", "subscriber", "subscriber_segment", "filter_assignment", "filter"):
        store.replace(f"platform_{name}", seeded[f"platform_{name}"])
    row = {"command_id": "c1", "environment": "local", "surface": "s", "occurred_at": NOW}
    given = [
        {**row, "action": "create-brief", "subject_type": "campaign", "subject_id": "fresh"},
        {**row, "command_id": "c2", "action": "launch-test-send", "subject_type": "campaign", "subject_id": "fresh"},
        {**row, "command_id": "c3", "action": "add-subscriber", "subject_id": "julian-thorne", "metadata": '{"filterTags":["New"]}'},
    ]
    batch = spark.createDataFrame([tuple(c.get(n) for n in COMMAND.names) for c in given], COMMAND)
    for _ in range(2):  # the second time changes nothing but times
        jobs.apply_commands(store, batch)
        assert rows(store.read("platform_campaign").where("campaign_id = 'fresh'"), "status", "display_order") == [("Scheduled", 6)]
        assert store.read("platform_campaign").count() == 6
        assert store.read("platform_campaign_analytics").count() == 6
        assert rows(store.read("platform_subscriber_segment").where("subscriber_id = 'julian-thorne'"), "segment_label") == [("Priority Review",)]
        assert rows(store.read("platform_filter_assignment").where("subscriber_id = 'julian-thorne'"), "filter_label") == [("New",)]
        assert store.read("platform_filter").count() == 5
        assert store.read("platform_subscriber").count() == 26


def test_drifted_tables_are_reset(spark, store):
    seeded = seed_tables(spark, NOW, members=1)
    for name in REQUIRED_COLUMNS:
        store.replace(name, seeded[name])
    assert jobs.reset_drifted(store) == []
    name = "platform_campaign_analytics"
    store.read(name).drop("bounce_recipients").coalesce(1).write.parquet(f"{store.root}/{name}/narrow/cell=0")
    (narrow,) = Path(f"{store.root}/{name}/narrow/cell=0".removeprefix("file:")).glob("part-*")
    store._publish(name, [f"narrow/cell=0/{narrow.name}"])
    assert jobs.reset_drifted(store) == list(REQUIRED_COLUMNS)
    assert store.read("platform_campaign_analytics").isEmpty()


def test_export_files_keep_statement_order(spark, tmp_path):
    tables = {k: v for k, v in seed_tables(spark, NOW).items() if k in ("platform_filter", "platform_campaign")}
    write_seed_export(tables, str(tmp_path / "export"))
    lines = [line for part in sorted((tmp_path / "export").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines == sorted(lines, key=lambda line: ("platform_campaign" in line, line)) and len(lines) == 9


def test_row_audit_of_an_empty_table(spark):
    assert audit.row_audit({"none": spark.range(0)}, "r", at(NOW)).first()["rows"] == 0


def test_emptied_partitions_of_odd_tenant_names(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "odd"))
    tenants = ["a:b/ c", "x=y%z", "plain"]
    frame = spark.createDataFrame([(t, f"s{n}", f"label{n}", n) for t in tenants for n in range(20)], "environment string, subscriber_id string, segment_label string, display_order int")
    frame = frame.select(*[F.col(c).cast(store.spec("platform_subscriber_segment").schema[c].dataType) for c in store.spec("platform_subscriber_segment").schema.names])
    store.append("platform_subscriber_segment", frame)
    for tenant in tenants[:2]:
        store.reload_tenant("platform_subscriber_segment", tenant, frame.limit(0))
    assert {r["environment"] for r in store.read("platform_subscriber_segment").collect()} == {"plain"}
