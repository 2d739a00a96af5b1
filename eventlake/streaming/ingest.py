"""Landing of the raw message stream and its parsed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventlake.plans.parse import parse_payload
from eventlake.sources.store import TableStore
from eventlake.streaming.state import keyed_state


def _drain(writer, once: bool) -> StreamingQuery:
    """All that is there now, then stop; or keep running."""
    return (writer.trigger(availableNow=True) if once else writer).start()


UNROUTED = "unrouted"


def write_bronze(batch: DataFrame, batch_id: int, folder: str, capture: str = "day") -> None:
    """Messages as text below bronze/<topic>/captured_at=<epoch>; each batch owns its files.

    The capture time is the start of the message's own ``capture`` unit, so a replay writes the
    same folders again, and a batch gives a few large files instead of one per message.
    Every topic of the batch is written; messages without one go to ``unrouted``.
    """
    captured = F.unix_seconds(F.date_trunc(capture, "timestamp"))
    topic_of = F.coalesce("topic", F.lit(UNROUTED))
    rows = batch.select(topic_of.alias("topic"), "value", captured.alias("captured_at"), F.lit(batch_id).alias("batch"))
    for topic in [row["topic"] for row in rows.select("topic").distinct().collect()]:  # as many as were subscribed to
        (
            rows.where(F.col("topic") == topic)
            .drop("topic")
            .hint("rebalance", "captured_at")  # few files per unit, a busy unit over several tasks
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("captured_at", "batch")
            .text(f"{folder}/{topic}")
        )


def dual_sink(messages: DataFrame, bronze: str, store: TableStore, checkpoint: str, stream: str = "landing", once: bool = True) -> StreamingQuery:
    """One pass over the stream into the bronze folder and the raw payload table. A replayed batch takes the place of its first attempt."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            write_bronze(batch, batch_id, bronze)
            store.append("raw_payload", batch.select(F.col("value").alias("payload")), (stream, batch_id))
        finally:
            batch.unpersist()

    return _drain(messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), once)


def events_view(
    messages: DataFrame, store: TableStore, checkpoint: str, stream: str = "events", once: bool = True, include_event_type: bool = False
) -> StreamingQuery:
    """The parsed events table, kept up with the stream: the table that backfills rewrite and readers read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append("raw_events", parse_payload(batch.select(F.col("value").alias("payload")), include_event_type), (stream, batch_id))

    return _drain(messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), once)


def first_arrivals(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", once: bool = True, partitions: int | None = None) -> StreamingQuery:
    """First arrival of every id, however late it comes; repeats are dropped against all ids that came before.

    The ids are keyed state without expiry: a batch looks up its own ids and adds the new ones, and reads nothing that
    earlier batches wrote. Each batch owns a partition, so a replay, which starts from the state before it,
    overwrites its own rows. Rows without an id are all kept and take no state. Of different rows that bring
    one new id in one batch, any may be the one that stays.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        owned = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        owned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    named = events.where(F.col(key).isNotNull()).dropDuplicates([key])
    kept = named.unionByName(events.where(F.col(key).isNull()))
    with keyed_state(events.sparkSession, partitions):
        return _drain(kept.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), once)


def append_stream(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    return _drain(
        events.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint), once
    )


def publish_stream(messages: DataFrame, servers: str, checkpoint: str) -> StreamingQuery:
    """Stream of publish frames to the broker. Needs the Kafka package."""
    return (
        messages.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("includeHeaders", "true")
        .option("checkpointLocation", checkpoint)
        .start()
    )


