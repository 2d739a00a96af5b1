"""Partner snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.json_values import canonical
from eventlake.functions.text import null_if_blank
from eventlake.functions.times import to_millis
from eventlake.operators.ordering import ordered_list, with_summary
from eventlake.schemas import PARTNER_RECORD
from eventlake.session import pinned


def array_items(spark: SparkSession, folder: str) -> DataFrame:
    """(file, number, item): texts of the items of JSON array files. A file is read by as many tasks as it has blocks.

    Files are read as pieces between commas. Whether a piece begins inside a string, and at which depth, depends on
    all pieces before it; a block is summed up for both cases (quotes left open, depth gained), the few summaries of a file
    are carried from block to block, and then each piece knows whether its comma parts two items of the array.
    """
    pieces = spark.read.option("lineSep", ",").text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    )
    block, bare = ["file", "block"], F.regexp_replace("value", r"\\.", "")  # without escaped characters
    steps = pieces.select(
        *block, "place", "value",
        (F.regexp_count(bare, F.lit('"')) % 2).alias("flips"),
        _depth_gained(bare).alias("if_outside"),
        _depth_gained(F.regexp_replace(bare, '^[^"]*("|$)', "")).alias("if_inside"),
    )
    in_block = Window.partitionBy(*block).orderBy("place")
    earlier, upto = in_block.rowsBetween(Window.unboundedPreceding, -1), in_block.rowsBetween(Window.unboundedPreceding, 0)
    flipped = F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2
    both = pinned(steps.withColumn("flipped", flipped)).select(
        "*",
        F.when(F.col("flipped") == 0, F.col("if_outside")).otherwise(F.col("if_inside")).alias("gained_0"),
        F.when(F.col("flipped") == 1, F.col("if_outside")).otherwise(F.col("if_inside")).alias("gained_1"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda column: F.coalesce(F.sum(column).over(before), F.lit(0))
    blocks = both.groupBy(*block).agg(F.sum("flips").alias("flips"), F.sum("gained_0").alias("gained_0"), F.sum("gained_1").alias("gained_1"))
    blocks = blocks.withColumn("inside", total("flips") % 2)
    blocks = blocks.withColumn("depth", total(F.when(F.col("inside") == 0, F.col("gained_0")).otherwise(F.col("gained_1"))))
    known = with_summary(both, blocks.select(*block, "inside", F.col("depth").alias("from_depth")), block)
    gained = F.when(F.col("inside") == 0, F.col("gained_0")).otherwise(F.col("gained_1"))
    placed = known.withColumn("depth", F.col("from_depth") + F.sum(gained).over(upto))
    placed = placed.withColumn("ends", ((F.col("inside") + F.col("flipped") + F.col("flips")) % 2 == 0) & (F.col("depth") <= 1))
    ended = placed.groupBy(*block).agg(F.count_if("ends").alias("items")).withColumn("items_before", total("items")).drop("items")
    number = F.col("items_before") + F.coalesce(F.count_if("ends").over(earlier), F.lit(0))
    numbered = with_summary(placed, ended, block).withColumn("number", number)
    items = numbered.groupBy("file", "number").agg(
        ordered_list(["block", "place"], "value").alias("parts"), F.bool_or(F.col("ends") & (F.col("depth") == 0)).alias("closes")
    )
    text = F.array_join("parts", ",")
    text = F.when(F.col("number") == 0, F.regexp_replace(text, r"^\s*\[", "")).otherwise(text)
    text = F.when(F.col("closes"), F.regexp_replace(text, r"\]\s*$", "")).otherwise(text)
    return items.select("file", "number", text.alias("item")).where(F.trim(F.translate("item", "\n\r\t", "   ")) != "")


def _depth_gained(text: Column) -> Column:
    """Brackets opened less brackets closed, outside strings, in a text that begins outside one."""
    outside = F.regexp_replace(text, '"[^"]*("|$)', "")
    return F.regexp_count(outside, F.lit(r"[\[{]")) - F.regexp_count(outside, F.lit(r"[\]}]"))


def snapshot_records(spark: SparkSession, folder: str, array: bool = True) -> DataFrame:
    """Landed snapshot files: a JSON array per file, or with ``array=False`` a record per line."""
    if array:
        read = array_items(spark, folder).select(F.from_json("item", PARTNER_RECORD).alias("record")).select("record.*")
    else:
        read = spark.read.schema(PARTNER_RECORD).json(folder)
    return read.withColumn("payload", F.to_json("payload"))


def snapshot_rows(records: DataFrame, captured_at: Column) -> DataFrame:
    """Records as rows of the snapshot log: UTC milliseconds, capture date, lineage key, sorted payload."""
    key = F.concat(F.lit(fx.SNAPSHOT_KEY_PREFIX), F.date_format(captured_at, fx.SNAPSHOT_STAMP), F.lit(fx.SNAPSHOT_KEY_SUFFIX))
    return records.select(
        "record_id",
        "provider",
        null_if_blank(F.col("account_id")).alias("account_id"),
        to_millis(F.col("collected_at")).alias("collected_at"),
        F.date_trunc("millisecond", captured_at).alias("captured_at"),
        F.to_date(captured_at).alias("captured_date"),
        key.alias("object_key"),
        canonical(F.coalesce("payload", F.lit("{}"))).alias("payload"),
    )


def raw_record_rows(records: DataFrame) -> DataFrame:
    """Records as rows of the raw record table; a missing account stays as it came."""
    return records.select(
        "record_id",
        "provider",
        "account_id",
        F.try_to_timestamp("collected_at").alias("collected_at"),
        canonical(F.coalesce("payload", F.lit("{}"))).alias("payload"),
    )


# Of equal record ids the first collected wins; content decides between equal times.
RECORD_ORDER = ("collected_at", "provider", "account_id", "payload")
