"""Bronze text rows and object listings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.text import object_topic


def bronze_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every object below the folder, with its file path."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(folder)
        .select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("file_path"))
    )


def key_of_path(path: Column) -> Column:
    """Object key below the bronze prefix of a full path, with URL escapes decoded."""
    below = F.regexp_extract(path, f"(?:^|/)({fx.BRONZE_PREFIX}/.*)$", 1)
    return F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))


WHOLE_BYTES = 1 << 30  # a longer object is not read as one value


def object_listing(spark: SparkSession, folder: str) -> DataFrame:
    """One row per object: path, key, topic, modification time, size. Reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", *listing_columns())


def listing_columns() -> list[Column]:
    key = key_of_path(F.col("path"))
    return [
        key.alias("object_key"),
        object_topic(key).alias("source_topic"),
        F.date_trunc("millisecond", "modificationTime").alias("last_modified"),
        F.col("length").alias("size"),
    ]


def literal_path(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def with_etags(objects: DataFrame, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """A bounded list of listed objects with the hash of their content; no other object is read.

    Objects of up to ``whole_bytes`` have the MD5 of their bytes. Longer ones are read as lines, split over tasks: their
    hash is that of the number of lines and the sum of the lines' hashes, marked by ``lines-``.
    """
    spark = objects.sparkSession
    listed = [(row["path"], row["size"]) for row in objects.select("path", "size").collect()]  # the caller bounds the list
    small = [literal_path(path) for path, size in listed if size <= whole_bytes]
    large = [literal_path(path) for path, size in listed if size > whole_bytes]
    parts = []
    if small:
        files = spark.read.format("binaryFile").load(small)
        parts.append(files.select("path", F.md5("content").alias("etag")))
    if large:
        lines = spark.read.text(large).select(F.col("_metadata.file_path").alias("path"), F.xxhash64("value").cast("decimal(20,0)").alias("hash"))
        summed = lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.sum("hash").alias("hashes"))
        parts.append(summed.select("path", F.concat(F.lit("lines-"), F.md5(F.concat_ws(":", "lines", "hashes").cast("binary"))).alias("etag")))
    if not parts:
        return objects.withColumn("etag", F.lit(None).cast("string"))
    hashed = reduce(DataFrame.unionByName, parts).select(key_of_path(F.col("path")).alias("object_key"), "etag")
    return objects.join(hashed, "object_key", "left")


def new_objects(listing: DataFrame, indexed: DataFrame) -> DataFrame:
    """Listed objects that the index lacks; folder markers are no objects."""
    objects = listing.where(~F.col("object_key").endswith("/"))
    return objects.join(indexed.select("object_key"), "object_key", "left_anti")


def sorted_listing(objects: DataFrame) -> DataFrame:
    """Objects in key order."""
    return objects.orderBy("object_key")


def index_rows(objects: DataFrame, processed_at: Column) -> DataFrame:
    processed = F.date_trunc("millisecond", processed_at)
    return objects.select(
        "object_key",
        F.nullif("etag", F.lit("")).alias("etag"),
        object_topic(F.col("object_key")).alias("source_topic"),
        F.date_trunc("millisecond", "last_modified").alias("last_modified"),
        processed.alias("processed_at"),
        F.to_date(processed).alias("processed_date"),
        F.col("size").cast("long").alias("size"),
    )


def rows_of_indexed_objects(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Bronze rows with the index entry of their object."""
    return rows.withColumn("object_key", key_of_path(F.col("file_path"))).join(index, "object_key")


# columns of the file source for whole files (fixed values)
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_listing(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """New objects below the folder as a stream, with the MD5 of their content; the checkpoint remembers what was seen."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return files.select("path", *listing_columns(), F.md5("content").alias("etag"))
