"""Row counts after loads, and schema drift."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.schemas import REQUIRED_COLUMNS


def row_audit(tables: Mapping[str, DataFrame], run_id: str, recorded_at: Column) -> DataFrame:
    """Rows per dataset as audit rows."""
    counts = [
        table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("dataset"), "rows") for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).select(
        "dataset", "rows", F.lit(run_id).alias("run_id"), recorded_at.alias("recorded_at")
    )


def columns_of(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Column catalogue (table_name, column_name) of the given tables."""
    pairs = [(name, field.name) for name, table in tables.items() for field in table.schema.fields]
    return spark.createDataFrame(pairs, "table_name string, column_name string")


def catalog_columns(spark: SparkSession, tables: list[str], schema: str | None = None) -> DataFrame:
    """Column catalogue of catalog tables; a missing table has no columns."""
    prefix = f"{schema}." if schema else ""
    pairs = [
        (name, column.name)
        for name in tables
        if spark.catalog.tableExists(prefix + name)
        for column in spark.catalog.listColumns(prefix + name)
    ]
    return spark.createDataFrame(pairs, "table_name string, column_name string")


def required_columns(spark: SparkSession, required: Mapping[str, tuple[str, ...]] = REQUIRED_COLUMNS) -> DataFrame:
    pairs = [(name, column) for name, columns in required.items() for column in columns]
    return spark.createDataFrame(pairs, "table_name string, column_name string")


def schema_drift(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required columns that an existing table lacks."""
    existing = required.join(present.select("table_name"), "table_name", "left_semi")
    return existing.join(present, ["table_name", "column_name"], "left_anti")
