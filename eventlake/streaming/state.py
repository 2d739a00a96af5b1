"""Keyed state of streams, kept in RocksDB."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Settings of the state store (fixed values): rows are looked up by key, and a batch writes its own changes only.
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: on executors' disks, its changes below the checkpoint.

    A stream keeps the number of state partitions it was first started with; ``partitions`` names it, else the session does.
    """
    wanted = ROCKSDB | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


class LastStatus(StatefulProcessor):
    """Remembers the status a route was left with, and gives the rows worth logging of each batch.

    A status older than ``keep_seconds`` counts as forgotten, by the times of the rows; with ``expire`` the state store also
    removes it, that time after its last change. Failures pass and are not remembered.
    """

    def __init__(self, columns: list[str], order: list[str], server_error: int, keep_seconds: int | None, expire: bool):
        self.columns, self.order, self.server_error, self.keep_seconds, self.expire = columns, order, server_error, keep_seconds, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_status", "status int, seen double", 1000 * self.keep_seconds if self.expire else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        failed = batch["status"] >= self.server_error
        answered = batch[~failed]
        previous = answered["status"].shift(1).astype("float64")
        if len(answered):
            seconds = answered[self.order[0]].map(lambda ts: ts.timestamp())
            remembered = self.last.get() if self.last.exists() else None
            if remembered is not None and (self.keep_seconds is None or seconds.iloc[0] - remembered[1] <= self.keep_seconds):
                previous.iloc[0] = remembered[0]
            self.last.update((int(answered["status"].iloc[-1]), float(seconds.iloc[-1])))
        changed = previous.notna() & (previous != answered["status"])
        out = pd.concat([
            batch[failed].assign(previous_status=pd.Series(dtype="Int32")),
            answered[changed].assign(previous_status=previous[changed].astype("Int32")),
        ])
        yield out[[*self.columns, "previous_status"]]

    def close(self) -> None:
        """Nothing is held between keys."""
