"""Order-sensitive operators that never hold a whole key in one task.

A plain window over a key sorts all rows of that key in one task. Here rows are cut into parts of about
equal size along (key, order); what a part needs from earlier ones comes from one summary row per key and part.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.session import pinned


PART, TIE = "_part", "_tie"


def ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows cut by number: range partitions of (key, order), of about equal size, numbered in ``_part``.

    A busy key spans as many partitions as it has rows for, also when all its rows have one time: ``_tie`` tells
    rows of equal order apart. Written once, as the borders come from a sample and must not be drawn again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn(TIE, F.monotonically_increasing_id())
    return pinned(tied.repartitionByRange(parts, *keys, *order, TIE).withColumn(PART, F.spark_partition_id()))


def with_summary(rows: DataFrame, summary: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the columns of their summary row; NULL keys are equal."""
    renamed = summary.select(*[F.col(name).alias(f"_key_{name}") for name in names], *[name for name in summary.columns if name not in names])
    same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_key_{name}")) for name in names])
    return rows.join(renamed, same, "left").drop(*[f"_key_{name}" for name in names])


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` within ``keys`` in ``order``.

    Each part is scanned by itself; the first row of a key in a part takes the last value of the parts before, which
    are one summary row per (key, part).
    """
    rows = ranged(df, keys, order)
    place = [*order, TIE]
    inside = Window.partitionBy(*keys, PART).orderBy(*place)
    lasts = rows.groupBy(*keys, PART).agg(F.max_by(value, F.struct(*place)).alias("_last"))
    carried = lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy(PART))).drop("_last")
    seen = rows.withColumns({"_first": F.row_number().over(inside) == 1, out: F.lag(value).over(inside)})
    linked = with_summary(seen, carried, [*keys, PART])
    return linked.withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(out))).drop(PART, TIE, "_first", "_carried")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``row_number()`` within ``keys`` in ``order``, as a bigint: places inside a part and the sizes of the parts before."""
    rows = ranged(df, keys, order)
    sizes = rows.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0).cast("long"))).drop("_size")
    inside = Window.partitionBy(*keys, PART).orderBy(*order, TIE)
    placed = with_summary(rows.withColumn(out, F.row_number().over(inside)), offsets, [*keys, PART])
    return placed.withColumn(out, F.col(out) + F.col("_offset")).drop(PART, TIE, "_offset")


def true_runs(df: DataFrame, keys: list[str], ts: str, condition: str) -> DataFrame:
    """Maximal runs of consecutive times at which the condition holds: start, end and row count.

    A run that crosses parts takes its start from the table of parts: a part passes the open
    run on when all its rows hold, else it opens the run that trails its last failing row.
    """
    # rows of one time are one sample, which holds if all of them do
    times = df.groupBy(*keys, ts).agg(F.bool_and(condition).alias(condition), F.count(F.lit(1)).alias("_n"))
    holds = F.col(condition)
    in_part = Window.partitionBy(*keys, PART).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    marked = ranged(times, keys, [ts]).withColumn("_fails", F.sum(F.when(holds, 0).otherwise(1)).over(in_part))
    pieces = (
        marked.groupBy(*keys, PART, "_fails")
        .agg(
            F.min(F.when(holds, F.col(ts))).alias("_first"),
            F.max(F.when(holds, F.col(ts))).alias("_last"),
            F.sum(F.when(holds, F.col("_n")).otherwise(0)).alias("_rows"),
        )
    )
    parts = pieces.groupBy(*keys, PART).agg(
        F.max("_fails").alias("_total_fails"), F.max_by("_first", "_fails").alias("_trailing")
    )
    by_part = Window.partitionBy(*keys).orderBy(PART)
    passes = F.col("_total_fails") == 0
    grouped = parts.withColumn(
        "_group", F.sum(F.when(passes, 0).otherwise(1)).over(by_part.rowsBetween(Window.unboundedPreceding, 0))
    )
    # Within a group only the first part can fail; its trailing run, or else the first passing part, opens the run.
    in_group = Window.partitionBy(*keys, "_group").orderBy(PART).rowsBetween(Window.unboundedPreceding, 0)
    opened = grouped.withColumn("_open", F.min("_trailing").over(in_group))
    carried = opened.select(*keys, PART, F.lag("_open").over(by_part).alias("_carry"))
    return (
        with_summary(pieces.where(F.col("_rows") > 0), carried, [*keys, PART])
        .withColumn("run_start", F.when(F.col("_fails") == 0, F.coalesce("_carry", "_first")).otherwise(F.col("_first")))
        .groupBy(*keys, "run_start")
        .agg(F.max("_last").alias("run_end"), F.sum("_rows").alias("samples"))
    )


def ordered_list(order: list[Column | str], item: Column | str) -> Column:
    """Aggregate: items as an array in the given order. NULL items are left out.

    For groups that are small by their keys.
    """
    item = F.col(item) if isinstance(item, str) else item
    row = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], item.alias("item"))
    return F.transform(F.array_sort(F.collect_list(F.when(item.isNotNull(), row))), lambda entry: entry["item"])


def page_block(order: Column, page_size: int) -> Column:
    return F.floor(order / F.lit(page_size))


def page_numbers(rows: DataFrame, keys: list[str], order: str, page_size: int) -> DataFrame:
    """Page of every block of order numbers: (keys, block, page).

    ``order`` is a whole number, unique per key. Blocks fill pages in order, so a page holds
    fewer than two page sizes of rows, and a key with few rows is page 0 however its numbers lie.
    """
    sizes = rows.groupBy(*keys, page_block(F.col(order), page_size).alias("block")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    return sizes.select(*keys, "block", F.floor(before / F.lit(page_size)).alias("page"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One whole row per key, the first in order; combines before it shuffles."""
    return _pick(df, keys, order, F.min_by)


def last_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One whole row per key, the last in order; combines before it shuffles."""
    return _pick(df, keys, order, F.max_by)


def _pick(df: DataFrame, keys: list[str], order: list[Column | str], pick) -> DataFrame:
    rest = [name for name in df.columns if name not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, "_row.*").select(*df.columns)
