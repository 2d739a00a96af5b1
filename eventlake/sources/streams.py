"""Message streams: subscription, publish frames and the offline stand-in."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventlake import fixed_values as fx
from eventlake.functions.json_values import object_text

TOPICS = (fx.EMAIL_TOPIC, fx.ANALYTICS_TOPIC)


def subscribe(spark: SparkSession, servers: str, topics: tuple[str, ...] = TOPICS, per_batch: int | None = None) -> DataFrame:
    """Both raw topics as one stream of messages (``message_columns``). Needs the Kafka package."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("startingOffsets", "earliest")
        .option("includeHeaders", "true")
    )
    if per_batch:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    return message_columns(reader.load())


def message_columns(messages: DataFrame) -> DataFrame:
    """Key and value as text, the place in the topic, and the correlation id that the publisher put into the headers."""
    named = F.filter("headers", lambda header: header["key"] == fx.CORRELATION_HEADER)
    correlation = F.decode(F.get(named, F.lit(0))["value"], "utf-8") if "headers" in messages.columns else F.lit(None).cast("string")
    return messages.select(
        "topic", F.col("key").cast("string"), F.col("value").cast("string"), "timestamp", "partition", "offset", correlation.alias("correlation_id")
    )


def source_lag(spark: SparkSession, progress: dict) -> DataFrame:
    """(source, topic, partition, start_offset, end_offset, latest_offset, lag) of one progress report of a streaming query.

    ``lag`` counts the messages that the batch left in the topic partition. Sources without offsets per partition give no rows.
    """
    found = []
    for source in progress.get("sources", ()):
        start, end, latest = (_offsets(source.get(name)) for name in ("startOffset", "endOffset", "latestOffset"))
        for (topic, partition), upto in sorted(end.items()):
            last = latest.get((topic, partition), upto)
            found.append((source.get("description"), topic, partition, start.get((topic, partition), 0), upto, last, last - upto))
    return spark.createDataFrame(found, "source string, topic string, partition int, start_offset long, end_offset long, latest_offset long, lag long")


def _offsets(report: dict | str | None) -> dict[tuple[str, int], int]:
    """Offsets by (topic, partition) of what a source reports, as text or parsed."""
    parsed = json.loads(report) if isinstance(report, str) else report
    if not isinstance(parsed, dict):
        return {}
    return {(topic, int(partition)): offset for topic, parts in parsed.items() if isinstance(parts, dict) for partition, offset in parts.items()}


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000, source: str = "parquet") -> DataFrame:
    """Files below a path, or a single file, as a stream."""
    reader = spark.readStream.schema(schema).format(source).option("maxFilesPerTrigger", files_per_batch)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) and files.getFileStatus(target).isFile():
        # a plain single file is refused: its folder is read, by its name
        return reader.option("pathGlobFilter", target.getName()).load(target.getParent().toString())
    return reader.load(path)


def publish_frame(events: DataFrame, topic: Column, key: Column, value: Column, correlation_id: Column) -> DataFrame:
    """Rows ready for the Kafka sink: topic, key, value and the correlation header."""
    header = F.struct(F.lit(fx.CORRELATION_HEADER).alias("key"), F.encode(correlation_id, "utf-8").alias("value"))
    return events.select(topic.alias("topic"), key.alias("key"), value.alias("value"), F.array(header).alias("headers"))


def message_value(events: DataFrame, names: tuple[str, ...]) -> Column:
    """Message body; the payload is nested as an object, ``{}`` if missing."""
    payload = F.try_parse_json(F.coalesce("payload", F.lit("{}")))
    return object_text(**{name: payload if name == "payload" else F.col(name) for name in names})


def email_messages(events: DataFrame) -> DataFrame:
    """Email events keyed by campaign."""
    value = message_value(events, ("event_id", "campaign_id", "recipient_id", "event_type", "occurred_at", "payload", "correlation_id"))
    return publish_frame(events, F.lit(fx.EMAIL_TOPIC), F.col("campaign_id"), value, F.col("correlation_id"))


def analytics_messages(events: DataFrame) -> DataFrame:
    """Analytics events keyed by user."""
    value = message_value(
        events, ("event_id", "session_id", "user_id", "event_name", "page_url", "occurred_at", "payload", "correlation_id")
    )
    return publish_frame(events, F.lit(fx.ANALYTICS_TOPIC), F.col("user_id"), value, F.col("correlation_id"))


def write_messages(messages: DataFrame, servers: str) -> None:
    """Batch publish. Needs the Kafka package."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("includeHeaders", "true").save()
