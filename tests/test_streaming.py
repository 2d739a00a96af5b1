"""Streams over several files and batches give what the batch forms give."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from frames import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlake.functions.times import at
from eventlake.operators.requests import status_transitions
from eventlake.plans import jobs
from eventlake.plans.parse import landed, parse_payload
from eventlake.session import scratch_dir
from eventlake.sources import bronze, streams
from eventlake.sources.store import TableStore
from eventlake.streaming import ingest, stateful

START = datetime(2024, 1, 1)


@pytest.fixture
def out(spark):
    return scratch_dir(spark, "test-stream")


def in_files(spark, frame, path, order, files):
    """The frame as several files, written in order so that a file stream reads them in order."""
    cut = frame.withColumn("_file", F.ntile(files).over(Window.orderBy(order)))
    for n in range(1, files + 1):
        cut.where(F.col("_file") == n).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return streams.file_stream(spark, path, frame.schema, files_per_batch=1)


@pytest.fixture(scope="module")
def messages(spark):
    bodies = [
        {"event": "open", "event_name": "x", "campaign_id": "c1", "user_id": "u", "occurred_at": "2024-01-01T00:00:01Z"},
        {"event": "", "event_name": "view", "user_id": 5, "occurred_at": "2024-01-01"},
        {"event_type": "ui_send", "campaign_id": None, "occurred_at": "soon"},
    ]
    values = [json.dumps(body) for body in bodies] * 4 + ["{broken", "[]", ""]
    topics = streams.TOPICS
    data = [(topics[n % 2], f"k{n}", value, START + timedelta(hours=n)) for n, value in enumerate(values)]
    return spark.createDataFrame(data, "topic string, key string, value string, timestamp timestamp")


def test_parsed_rows(messages):
    got = rows(parse_payload(landed(messages)).dropDuplicates(["payload"]), "event_name", "campaign_id", "user_id", F.year("occurred_at"))
    assert got == [("", "", "", 1970)] * 4 + [("open", "c1", "u", 2024), ("view", "", "", 2024)]
    named = parse_payload(landed(messages), include_event_type=True)
    assert "ui_send" in {r["event_name"] for r in named.collect()}


def test_events_view_equals_batch_parse_and_survives_restart(spark, messages, out):
    stream = in_files(spark, messages, f"{out}/in", "timestamp", 3)
    store = TableStore(spark, f"{out}/store")
    for _ in range(2):
        ingest.events_view(stream, store, f"{out}/checkpoint").awaitTermination()
    assert rows(store.read("raw_events")) == rows(parse_payload(landed(messages)))


def replay(checkpoint, start):
    """Run the last batch again, as after a crash between its output and its commit."""
    commits = Path(checkpoint.removeprefix("file:")) / "commits"
    last = max((path for path in commits.iterdir() if path.name.isdigit()), key=lambda path: int(path.name))
    last.unlink()
    (commits / f".{last.name}.crc").unlink(missing_ok=True)
    start().awaitTermination()


def test_dual_sink_and_replay(spark, messages, out):
    stream, store = in_files(spark, messages, f"{out}/in", "timestamp", 2), TableStore(spark, f"{out}/store")
    start = lambda: ingest.dual_sink(stream, f"{out}/bronze", store, f"{out}/checkpoint")
    start().awaitTermination()
    want = rows(messages, "value")
    for _ in range(2):
        assert rows(store.read("raw_payload"), "payload") == want
        assert rows(bronze.bronze_rows(spark, f"{out}/bronze"), "content") == want
        replay(f"{out}/checkpoint", start)
    keys = {r["object_key"] for r in bronze.object_listing(spark, f"{out}/bronze").collect()}
    assert all(key.split("/")[1] in streams.TOPICS and key.split("/")[2].startswith("captured_at=1704067200") for key in keys)


def test_stream_and_backfill_share_the_table(spark, messages, out):
    stream, store = in_files(spark, messages, f"{out}/in", "timestamp", 3), TableStore(spark, f"{out}/store")
    start = lambda: ingest.events_view(stream, store, f"{out}/checkpoint")
    ingest.dual_sink(stream, f"{out}/bronze", store, f"{out}/landing").awaitTermination()
    start().awaitTermination()
    want = rows(parse_payload(landed(messages)))
    before = store.files("raw_events", ["2024-01-01"])
    for _ in range(2):
        jobs.backfill_events(store, dates=[date(1970, 1, 1)])
        assert rows(store.read("raw_events")) == want
    assert store.files("raw_events", ["2024-01-01"]) == before  # other days keep their files
    replay(f"{out}/checkpoint", start)  # part of the batch was rewritten meanwhile
    assert rows(store.read("raw_events")) == want
    jobs.backfill_events(store)
    replay(f"{out}/checkpoint", start)
    assert rows(store.read("raw_events")) == want


def test_repeats_are_dropped_across_batches(spark, out):
    data = [(f"e{n % 10}", "view", START + timedelta(minutes=n)) for n in range(40)]
    frame = spark.createDataFrame(data, "event_id string, event_name string, occurred_at timestamp")
    stream = in_files(spark, frame, f"{out}/in", "occurred_at", 4)
    start = lambda: ingest.first_arrivals(stream, f"{out}/events", f"{out}/checkpoint")
    started = start()
    started.awaitTermination()
    for _ in range(2):
        assert rows(spark.read.parquet(f"{out}/events"), "event_id") == [(f"e{n}",) for n in range(10)]
        replay(f"{out}/checkpoint", start)
    # work per batch: the state takes up the ids of the batch that are new, and nothing that was written is read
    updated = [batch.stateOperators[0].numRowsUpdated for batch in started.recentProgress if batch.numInputRows]
    assert len(updated) == 4 and sum(updated) == 10
    assert all("FileStreamSource" in source.description for batch in started.recentProgress for source in batch.sources)


def late_first(spark, frame, folder, cut):
    """Two files of a stream: the rows from ``cut`` on come first, those before it late."""
    for n, part in enumerate((frame.where(F.col("occurred_at") >= cut), frame.where(F.col("occurred_at") < cut))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_late_ids_are_kept(spark, out):
    data = [(f"e{n % 30}", START + timedelta(days=n)) for n in range(60)]
    frame = spark.createDataFrame([*data, (None, START), (None, START)], "event_id string, occurred_at timestamp")
    stream = late_first(spark, frame, f"{out}/in", START + timedelta(days=45))
    ingest.first_arrivals(stream, f"{out}/events", f"{out}/checkpoint").awaitTermination()
    assert rows(spark.read.parquet(f"{out}/events"), "event_id") == sorted([(f"e{n}",) for n in range(30)] + [(None,), (None,)], key=lambda r: (r[0] is None, str(r[0])))


def test_late_events_count(spark, out):
    data = [("env", START + timedelta(days=n // 2)) for n in range(60)]
    frame = spark.createDataFrame(data, "environment string, occurred_at timestamp")
    store = TableStore(spark, f"{out}/store")
    stream = late_first(spark, frame, f"{out}/in", START + timedelta(days=20))
    stateful.maintain_daily(stream, store, at("2024-03-01"), f"{out}/checkpoint").awaitTermination()
    want = frame.groupBy("environment", F.to_date("occurred_at").alias("d")).count()
    assert rows(store.read("platform_daily_performance"), "environment", "bucket_date", "event_count") == rows(want)


def test_bronze_keeps_every_topic(spark, out):
    batch = spark.createDataFrame([("other", "a", START), (None, "b", START), ("email_events_raw", "c", START)], "topic string, value string, timestamp timestamp")
    ingest.write_bronze(batch, 0, f"{out}/bronze")
    assert rows(bronze.bronze_rows(spark, f"{out}/bronze"), "content") == [("a",), ("b",), ("c",)]


def test_daily_counts_across_batches(spark, out):
    data = [("env" + str(n % 2), START + timedelta(hours=5 * n)) for n in range(40)]
    frame = spark.createDataFrame(data, "environment string, occurred_at timestamp")
    store = TableStore(spark, f"{out}/store")
    stream = in_files(spark, frame, f"{out}/in", "occurred_at", 3)
    for _ in range(2):
        stateful.maintain_daily(stream, store, at("2024-02-01"), f"{out}/checkpoint").awaitTermination()
    want = frame.groupBy("environment", F.to_date("occurred_at").alias("d")).count()
    assert rows(store.read("platform_daily_performance"), "environment", "bucket_date", "event_count") == rows(want)


def test_one_day_rewrites_one_day(spark, out):
    data = [("env", START + timedelta(days=n)) for n in range(6)]
    schema, store = "environment string, occurred_at timestamp", TableStore(spark, f"{out}/store")
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
    start = lambda: stateful.maintain_daily(streams.file_stream(spark, f"{out}/in", frame.schema), store, at("2024-02-01"), f"{out}/checkpoint")
    frame = spark.createDataFrame([("env", START), ("other", START)], schema)
    start().awaitTermination()
    before = set(store.files("platform_daily_performance"))
    frame.coalesce(1).write.mode("append").parquet(f"{out}/in")
    start().awaitTermination()
    gone = before - set(store.files("platform_daily_performance"))
    assert {file.split("/")[1] for file in gone} == {"cell=2024-01-01"}
    assert rows(store.read("platform_daily_performance", ["2024-01-01"]), "environment", "event_count") == [("env", 2), ("other", 1)]
    assert store.read("platform_daily_performance").count() == 7


def test_transitions_across_batches(spark, out):
    statuses = [200, 200, 404, 500, 404, 200, 503, 200, 301, 200, 200, 404]
    data = [("s", "GET", f"/r{n % 2}", status, START + timedelta(minutes=n), n) for n, status in enumerate(statuses)]
    frame = spark.createDataFrame([*data, ("s", "GET", None, None, START, 99)], "service string, method string, route string, status int, ts timestamp, request_id long")
    stream = in_files(spark, frame, f"{out}/in", "ts", 6)
    start = lambda: stateful.follow_transitions(stream, f"{out}/rows", f"{out}/checkpoint")
    started = start()
    started.awaitTermination()
    columns = ("request_id", "status", "previous_status")
    for _ in range(2):
        assert rows(spark.read.parquet(f"{out}/rows"), *columns) == rows(status_transitions(frame), *columns)
        replay(f"{out}/checkpoint", start)
    assert all(batch.stateOperators[0].numRowsUpdated <= 2 for batch in started.recentProgress if batch.numInputRows)


def test_forgotten_routes(spark, out):
    """A route that was not seen for a while starts anew."""
    schema = "service string, method string, route string, status int, ts timestamp, request_id long"
    for n, status in enumerate((200, 404)):
        spark.createDataFrame([("s", "GET", "/r", status, START + timedelta(minutes=n), n)], schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
        stream = streams.file_stream(spark, f"{out}/in", spark.createDataFrame([], schema).schema)
        for name, keep in (("short", 59), ("long", 60)):
            stateful.follow_transitions(stream, f"{out}/{name}", f"{out}/{name}-checkpoint", keep_seconds=keep).awaitTermination()
    seen = {name: rows(spark.read.schema(f"{schema}, previous_status int").parquet(f"{out}/{name}"), "status", "previous_status") for name in ("short", "long")}
    assert seen == {"short": [], "long": [(404, 200)]}


def test_correlation_and_offsets_on_read(spark):
    event = spark.createDataFrame(
        [("e1", "c1", None, "open", "2024-01-01T00:00:00Z", "{}", "corr-é"), ("e2", "c1", None, "open", "2024-01-01T00:00:00Z", "{}", None)],
        "event_id string, campaign_id string, recipient_id string, event_type string, occurred_at string, payload string, correlation_id string",
    )
    sent = streams.email_messages(event).withColumns({
        "key": F.encode("key", "utf-8"), "value": F.encode("value", "utf-8"), "timestamp": F.lit(START), "partition": F.lit(3), "offset": F.monotonically_increasing_id(),
    })
    got = streams.message_columns(sent)
    assert rows(got.select(F.get_json_object("value", "$.event_id").alias("id"), "correlation_id", "partition")) == [("e1", "corr-é", 3), ("e2", None, 3)]
    assert rows(streams.message_columns(sent.drop("headers")), "correlation_id") == [(None,), (None,)]


def test_lag_of_a_progress_report(spark):
    source = {"description": "KafkaV2", "startOffset": '{"a":{"0":5,"1":0}}', "endOffset": {"a": {"0": 9, "1": 4}}, "latestOffset": '{"a":{"0":12,"1":4}}'}
    got = streams.source_lag(spark, {"sources": [source, {"description": "files", "startOffset": None, "endOffset": '{"logOffset":1}'}]})
    assert rows(got, "topic", "partition", "start_offset", "end_offset", "latest_offset", "lag") == [("a", 0, 5, 9, 12, 3), ("a", 1, 0, 4, 4, 0)]
    assert streams.source_lag(spark, {}).isEmpty()


def test_new_files_are_found_once(spark, out, tmp_path):
    folder = tmp_path / "bronze" / "analytics_events_raw"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text("{}")
    for name in ("2.json", "3.json"):
        listing = bronze.stream_listing(spark, str(tmp_path / "bronze"))
        ingest.append_stream(listing, f"{out}/index", f"{out}/checkpoint").awaitTermination()
        (folder / name).write_text("{}")
    assert rows(spark.read.parquet(f"{out}/index"), "object_key") == [(f"bronze/analytics_events_raw/{n}.json",) for n in (1, 2)]


def test_publish_frames(spark):
    event = spark.createDataFrame(
        [("e1", "c1", None, "open", "2024-01-01T00:00:00Z", '{"a":1}', "corr-1")],
        "event_id string, campaign_id string, recipient_id string, event_type string, occurred_at string, payload string, correlation_id string",
    )
    row = streams.email_messages(event).first()
    assert (row["topic"], row["key"]) == ("email_events_raw", "c1")
    assert json.loads(row["value"]) == {
        "event_id": "e1", "campaign_id": "c1", "recipient_id": None, "event_type": "open", "occurred_at": "2024-01-01T00:00:00Z",
        "payload": {"a": 1}, "correlation_id": "corr-1",
    }
    assert row["headers"][0]["key"] == "x-correlation-id" and bytes(row["headers"][0]["value"]) == b"corr-1"
