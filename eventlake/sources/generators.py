"""Generated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake import fixed_values as fx


def numbers(spark: SparkSession, count: int, name: str = "sequence_id") -> DataFrame:
    """1 .. count."""
    return spark.range(1, count + 1).withColumnRenamed("id", name)


def with_days(tenants: DataFrame, last_day: Column, days: int = fx.BAR_DAYS, name: str = "bucket_date") -> DataFrame:
    """Every row once for each of the ``days`` days that end at ``last_day``."""
    last = F.to_date(last_day)
    return tenants.withColumn(name, F.explode(F.sequence(F.date_sub(last, days - 1), last)))
