from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from frames import rows
from pyspark.sql import functions as F

from eventlake.operators import metrics
from eventlake.operators.requests import last_statuses, status_transitions

START = datetime(2024, 1, 1)


def counter(spark, values, metric="c", step=60, **labels):
    data = [(metric, labels, START + timedelta(seconds=n * step), float(v)) for n, v in enumerate(values)]
    return spark.createDataFrame(data, "metric string, labels map<string,string>, ts timestamp, value double")


def test_counter_reset_counts_the_new_value(spark):
    df = counter(spark, [5, 8, 2, 4], service="s", status="200")
    assert metrics.counter_increase(df, "c", ["service"], 3600).first()["increase"] == 3 + 2 + 2
    assert metrics.counter_rate(df, "c", ["service"], 3600).first()["rate"] == 7 / 3600


def test_steps_across_a_range_edge_count_in_the_later_range(spark):
    df = counter(spark, [0, 10, 100, 110], step=1800, service="s")
    assert sorted(r["increase"] for r in metrics.counter_increase(df, "c", ["service"], 3600).collect()) == [10, 100]
    hourly = counter(spark, range(6), step=3600, service="s")
    assert sum(r["increase"] for r in metrics.counter_increase(hourly, "c", ["service"], 3600).collect()) == 5


def test_rows_of_one_time_are_one_sample(spark):
    times = [0, 5, 10, 10, 15, 20, 25]
    values = [0, 0, 0, 1, 0, 0, 0]
    for order in (1, -1):
        data = [("j", START + timedelta(minutes=t), float(v)) for t, v in list(zip(times, values, strict=True))[::order]]
        df = spark.createDataFrame(data, "job string, ts timestamp, value double")
        runs = metrics.held_condition(df, ["job"], F.col("value") == 0, 0).collect()
        spans = sorted(((r["run_start"] - START).seconds // 60, (r["run_end"] - START).seconds // 60, r["samples"]) for r in runs)
        assert spans == [(0, 5, 2), (15, 25, 3)]


def test_series_of_one_label_value_add_up(spark):
    df = counter(spark, [0, 4], service="s", route="/a").unionByName(counter(spark, [100, 101], service="s", route="/b"))
    assert metrics.counter_increase(df, "c", ["service"], 3600).first()["increase"] == 5


def test_error_ratio_and_floor(spark):
    df = counter(spark, [0, 30], service="s", status="503").unionByName(counter(spark, [0, 60], service="s", status="200"))
    assert metrics.error_ratio(df, "c", ["service"], 300).first()["error_ratio"] == pytest.approx(30 / 90)
    still = counter(spark, [7, 7], service="s", status="500")
    assert metrics.error_ratio(still, "c", ["service"], 300).first()["error_ratio"] == 0


def quantile(spark, buckets, q=0.95):
    df = spark.createDataFrame([("k", le, float(n)) for le, n in buckets], "key string, le string, observed double")
    return metrics.quantile_of_buckets(df, ["key"], "observed", q).first()["quantile"]


def test_quantile_interpolates(spark):
    assert quantile(spark, [("1", 50), ("2", 100), ("+Inf", 100)], 0.75) == pytest.approx(1.5)
    assert quantile(spark, [("1", 50), ("2", 100), ("+Inf", 100)], 0.25) == pytest.approx(0.5)


def test_quantile_corner_cases(spark):
    assert quantile(spark, [("1", 10), ("2", 20), ("+Inf", 100)]) == 2  # in the open bucket: highest finite bound
    assert quantile(spark, [("1", 10), ("2", 20)]) is None  # no open bucket
    assert quantile(spark, [("1", 0), ("+Inf", 0)]) is None  # no observations
    assert quantile(spark, [("1", 10), ("2", 8), ("+Inf", 10)], 0.5) == pytest.approx(0.5)  # dips are levelled


def test_condition_must_hold_long_enough(spark):
    down = [1, 0, 0, 0, 1, 0, 0, 1]
    df = counter(spark, down, metric="up", job="gate")
    assert rows(metrics.service_down(df, "gate|bus", 120), "job", "samples") == [("gate", 3)]
    assert rows(metrics.service_down(df, "gate", 0), "job", "samples") == [("gate", 2), ("gate", 3)]
    assert metrics.service_down(df, "gat", 0).isEmpty()  # the pattern matches whole names
    assert rows(metrics.service_health(df, "g.*"), "job", "value") == [("gate", 1.0)]


def test_run_rollup(spark):
    data = [("r", "op", "success" if n else "error", float(n * 10), START) for n in range(100)]
    row = metrics.run_rollup(spark.createDataFrame(data, "run_id string, op_name string, status string, duration_ms double, ts timestamp")).first()
    assert (row["runs"], row["errors"], row["longest_ms"]) == (100, 1, 990)
    assert 0.75 < row["p95_seconds"] <= 1.0


def log(spark, statuses, start=0, route="/a"):
    data = [("s", "GET", route, status, START + timedelta(seconds=start + n), start + n) for n, status in enumerate(statuses)]
    return spark.createDataFrame(data, "service string, method string, route string, status int, ts timestamp, request_id long")


def test_server_errors_are_emitted_but_never_remembered(spark):
    got = status_transitions(log(spark, [200, 500, 200, 404, 503, 404, 200]))
    assert rows(got, "request_id", "status", "previous_status") == [(1, 500, None), (3, 404, 200), (4, 503, None), (6, 200, 404)]


def test_remembered_status_starts_a_batch(spark):
    first = log(spark, [404, 500])
    second = log(spark, [200, 200], start=10)
    got = status_transitions(second, last_statuses(first))
    assert rows(got, "request_id", "previous_status") == [(10, 404)]
    assert status_transitions(second).isEmpty()


def test_gauge_latest(spark):
    df = counter(spark, [1, 9, 4], node="n")
    assert rows(metrics.gauge_latest(df, "c", ["node"]), "node", "value") == [("n", 4.0)]
    assert metrics.gauge_latest(df.where(F.lit(False)), "c", ["node"]).isEmpty()
