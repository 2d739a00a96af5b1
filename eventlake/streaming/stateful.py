"""Streams that carry state: daily counts and status transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from eventlake.operators.requests import ORDER, ROUTE, SERVER_ERROR
from eventlake.sources.store import TableStore
from eventlake.streaming.ingest import _drain
from eventlake.streaming.state import LastStatus, keyed_state


def daily_counts(events: DataFrame) -> DataFrame:
    """Event-time counts per tenant and day, in update mode. Every event counts, however late; the state is one number per tenant and day."""
    return (
        events.where(F.col("occurred_at").isNotNull())
        .groupBy(F.window("occurred_at", "1 day"), "environment")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .select("environment", F.to_date("window.start").alias("bucket_date"), "event_count")
    )


def maintain_daily(
    events: DataFrame, store: TableStore, refreshed_at: Column, checkpoint: str, once: bool = True, partitions: int | None = None
) -> StreamingQuery:
    """Keep the daily table up with the stream. The counts are keyed state; a batch gives the whole counts of the
    tenants and days it touched, and rewrites the files of these days alone. A replay changes nothing."""
    store.ensure("platform_daily_performance")

    def write(batch: DataFrame, _: int) -> None:
        store.upsert("platform_daily_performance", batch.withColumn("refreshed_at", refreshed_at), ["event_count", "refreshed_at"])

    with keyed_state(events.sparkSession, partitions):
        writer = daily_counts(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return _drain(writer, once)


def follow_transitions(
    log: DataFrame, out: str, checkpoint: str, keep_seconds: int | None = None, once: bool = True, partitions: int | None = None
) -> StreamingQuery:
    """Status transitions of a request-log stream, each batch in a partition of its own.

    The status a route was left with is keyed state: a batch reads and writes the routes it brings, and no others; a replay starts
    from the state before it and gives the same rows. A route unseen for ``keep_seconds`` is forgotten; a stream that keeps
    running also removes its state. The rows that one batch brings for one route are ordered in one task; batches
    bound them. For whole logs, ``status_transitions`` spreads a busy route over tasks.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        owned = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        owned.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    schema = StructType([*log.schema.fields, StructField("previous_status", IntegerType())])
    expire = keep_seconds is not None and not once  # the timers of expiry would keep a bounded run from ending
    processor = LastStatus(log.columns, ORDER, SERVER_ERROR, keep_seconds, expire)
    with keyed_state(log.sparkSession, partitions):
        rows = log.where(F.col("status").isNotNull()).groupBy(*ROUTE).transformWithStateInPandas(
            processor, outputStructType=schema, outputMode="Update", timeMode="ProcessingTime" if expire else "None"
        )
        return _drain(rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint), once)
