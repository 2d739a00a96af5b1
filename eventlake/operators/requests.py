"""Status transitions in request logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.operators.ordering import previous_value

SERVER_ERROR = 500
ROUTE = ["service", "route"]
ORDER = ["ts", "request_id"]


def status_transitions(log: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Rows worth logging: every server error, and any other row whose status differs from the
    status its route had before. Server errors are never remembered; the first status of a route
    emits nothing.

    ``remembered`` (service, route, last_status) holds the statuses known before this log.
    """
    failures = log.where(F.col("status") >= SERVER_ERROR).withColumn("previous_status", F.lit(None).cast("int"))
    answered = previous_value(log.where(F.col("status") < SERVER_ERROR), ROUTE, ORDER, "status", "previous_status")
    if remembered is not None:
        answered = (
            answered.join(remembered.select(*ROUTE, "last_status"), ROUTE, "left")
            .withColumn("previous_status", F.coalesce("previous_status", "last_status"))
            .drop("last_status")
        )
    changed = answered.where(F.col("previous_status") != F.col("status"))
    return failures.unionByName(changed)


def last_statuses(log: DataFrame) -> DataFrame:
    """Status each route is left with, server errors aside."""
    answered = log.where(F.col("status") < SERVER_ERROR)
    return answered.groupBy(*ROUTE).agg(F.max_by("status", F.struct(*ORDER)).alias("last_status"))
