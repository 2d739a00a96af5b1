"""Keyed table changes as joins: each returns the changed rows or the changed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.operators.ordering import first_per_key


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Insert new keys; on existing keys set only the ``update`` columns.

    ``source`` holds one row per key. Columns missing from ``source`` are NULL on insert.
    """
    old = target.withColumn("_old", F.lit(True)).alias("old")
    new = source.withColumn("_new", F.lit(True)).alias("new")
    joined = old.join(new, list(keys), "full_outer")

    def merged(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name not in source.columns:
            return F.col(f"old.{name}").alias(name)
        winner = F.col("_new") if name in update else F.col("_old").isNull()
        return F.when(winner, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return joined.select(*[merged(name) for name in target.columns])


def absent_rows(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Source rows whose key the target lacks; of equal keys the first in order.

    Repeats are reduced first, so that a key with many copies never reaches the join as such.
    """
    firsts = first_per_key(source, list(keys), list(order))
    return firsts.join(target.select(*keys), list(keys), "left_anti")


def update_matching(
    target: DataFrame, keys_to_update: DataFrame, keys: Sequence[str], values: dict[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Set ``values`` where the key matches: the changed table, and the keys that match nothing."""
    marked = target.join(keys_to_update.select(*keys).distinct().withColumn("_hit", F.lit(True)), list(keys), "left")
    changed = [
        F.when(F.col("_hit"), values[name]).otherwise(F.col(name)).alias(name) if name in values else F.col(name)
        for name in target.columns
    ]
    missed = keys_to_update.join(target.select(*keys), list(keys), "left_anti")
    return marked.select(*changed), missed


def replace_children(target: DataFrame, touched: DataFrame, children: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete the child rows of all touched keys and put the new ones in."""
    kept = target.join(touched.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(children.select(*target.columns))


def next_order(target: DataFrame, keys: Sequence[str], order_column: str) -> DataFrame:
    """Highest order number in use per tenant, 0 where there is none."""
    return target.groupBy(*keys).agg(F.coalesce(F.max(order_column), F.lit(0)).alias("last_order"))
