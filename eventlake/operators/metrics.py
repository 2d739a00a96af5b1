"""Analytics over metric samples ``(metric, labels, ts, value)`` and run logs.

Ranges are tumbling windows over the whole time axis. A counter's increase in a range is the
sum of the steps to its samples inside the range, also from the last sample of an earlier range;
after a reset the new value counts as the step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake import fixed_values as fx
from eventlake.functions.times import window_start
from eventlake.operators.ordering import previous_value, true_runs


def series_of(labels: Column) -> Column:
    """Identity of a series. A map is no grouping key, the text of its sorted entries is."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def counter_steps(samples: DataFrame, metric: str, labels: list[str], range_seconds: int) -> DataFrame:
    """One row per sample: wanted labels, window and the counter's step since the sample before."""
    chosen = samples.where(F.col("metric") == metric).select(
        series_of(F.col("labels")).alias("series"),
        *[F.coalesce(F.col("labels")[label], F.lit("")).alias(label) for label in labels],
        window_start(F.col("ts"), range_seconds).alias("window_start"),
        "ts",
        "value",
    )
    stepped = previous_value(chosen, ["series"], ["ts", "value"], "value", "previous")
    value, previous = F.col("value"), F.col("previous")
    step = F.when(previous.isNull(), 0.0).when(value < previous, value).otherwise(value - previous)
    return stepped.select(*labels, "window_start", step.alias("step"))


def counter_increase(samples: DataFrame, metric: str, by: list[str], range_seconds: int) -> DataFrame:
    steps = counter_steps(samples, metric, by, range_seconds)
    return steps.groupBy(*by, "window_start").agg(F.sum("step").alias("increase"))


def counter_rate(samples: DataFrame, metric: str, by: list[str], range_seconds: int) -> DataFrame:
    increase = counter_increase(samples, metric, by, range_seconds)
    return increase.select(*by, "window_start", (F.col("increase") / range_seconds).alias("rate"))


def error_ratio(samples: DataFrame, metric: str, by: list[str], range_seconds: int) -> DataFrame:
    """Rate of server errors over the rate of all requests, the latter not below a floor."""
    steps = counter_steps(samples, metric, list(dict.fromkeys([*by, "status"])), range_seconds)
    failed = F.sum(F.when(F.col("status").rlike(fx.SERVER_ERROR_PATTERN), F.col("step")).otherwise(0.0)) / range_seconds
    total = F.sum("step") / range_seconds
    return steps.groupBy(*by, "window_start").agg((failed / F.greatest(total, F.lit(fx.RATIO_FLOOR))).alias("error_ratio"))


def histogram_quantile(
    samples: DataFrame, metric: str, by: list[str], range_seconds: int, quantile: float = fx.P95
) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds it.

    Needs the ``+Inf`` bucket and a finite one; without them, or without observations, it is NULL.
    A quantile in the ``+Inf`` bucket reads as the highest finite bound.
    """
    rates = counter_rate(samples, metric, [*by, "le"], range_seconds)
    return quantile_of_buckets(rates, [*by, "window_start"], "rate", quantile)


def quantile_of_buckets(buckets: DataFrame, keys: list[str], count: str, quantile: float) -> DataFrame:
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    bounded = buckets.withColumn("bound", bound)
    rising = Window.partitionBy(*keys).orderBy("bound")
    whole = Window.partitionBy(*keys)
    finite = F.col("bound") < float("inf")
    ranked = (
        bounded.withColumn("cum", F.max(count).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("below", F.coalesce(F.lag("cum").over(rising), F.lit(0.0)))
        .withColumn("low", F.coalesce(F.lag("bound").over(rising), F.least(F.lit(0.0), "bound")))
        .withColumn("total", F.max("cum").over(whole))
        .withColumn("top", F.max("bound").over(whole))
        .withColumn("finite_top", F.max(F.when(finite, F.col("bound"))).over(whole))
    )
    rank = F.col("total") * quantile
    inside = F.col("low") + (F.col("bound") - F.col("low")) * (rank - F.col("below")) / (F.col("cum") - F.col("below"))
    value = F.when(~finite, F.col("finite_top")).when(F.col("cum") == F.col("below"), F.col("bound")).otherwise(inside)
    usable = (F.col("top") == float("inf")) & (F.col("total") > 0)
    return ranked.groupBy(*keys).agg(
        F.min_by(F.when(usable, value), F.when(F.col("cum") >= rank, F.col("bound"))).alias("quantile")
    )


def held_condition(samples: DataFrame, keys: list[str], condition: Column, hold_seconds: int) -> DataFrame:
    """Runs of consecutive samples whose condition held for at least the given time."""
    flagged = samples.withColumn("holds", F.coalesce(condition, F.lit(False)))
    runs = true_runs(flagged, keys, "ts", "holds")
    held = F.unix_micros("run_end") - F.unix_micros("run_start") >= F.lit(hold_seconds * 1_000_000)
    return runs.where(held)


def service_down(samples: DataFrame, job_pattern: str, hold_seconds: int = 120) -> DataFrame:
    """Jobs (by full-match pattern) whose health gauge stayed 0 for the given time."""
    health = samples.where(F.col("metric") == "up").select(F.col("labels")["job"].alias("job"), "ts", "value")
    chosen = health.where(F.col("job").rlike(f"^(?:{job_pattern})$"))
    return held_condition(chosen, ["job"], F.col("value") == 0, hold_seconds)


def service_health(samples: DataFrame, job_pattern: str) -> DataFrame:
    """Latest health of the jobs that match."""
    latest = gauge_latest(samples, "up", ["job"])
    return latest.where(F.col("job").rlike(f"^(?:{job_pattern})$"))


def gauge_latest(samples: DataFrame, metric: str, by: list[str]) -> DataFrame:
    chosen = samples.where(F.col("metric") == metric)
    return chosen.groupBy(*[F.col("labels")[label].alias(label) for label in by]).agg(
        F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts")
    )


# Upper bounds in seconds of the run-duration histogram (fixed values).
RUN_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def run_rollup(runs: DataFrame, bounds: tuple[float, ...] = RUN_BOUNDS) -> DataFrame:
    """Runs, errors and duration per operation; the p95 comes from the histogram buckets."""
    seconds = F.col("duration_ms") / 1000
    labels = [str(bound) for bound in bounds] + ["+Inf"]
    counts = [F.count_if(seconds <= bound) for bound in bounds] + [F.count(F.lit(1))]
    per_op = runs.groupBy("op_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("duration_ms").alias("total_ms"),
        F.max("duration_ms").alias("longest_ms"),
        F.array(
            *[F.struct(F.lit(le).alias("le"), n.cast("double").alias("observed")) for le, n in zip(labels, counts, strict=True)]
        ).alias("buckets"),
    )
    p95 = quantile_of_buckets(
        per_op.select("op_name", F.inline("buckets")), ["op_name"], "observed", fx.P95
    ).withColumnRenamed("quantile", "p95_seconds")
    return per_op.drop("buckets").join(p95, "op_name")
