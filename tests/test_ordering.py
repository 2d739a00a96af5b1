"""Operators over row ranges against plain windows and loops on random data."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from frames import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlake.operators import ordering

START = datetime(2024, 1, 1)


def samples(spark, seed, count=400, keys=("a", "b", "hot", "hot", "hot")):
    rng = random.Random(seed)
    seconds = rng.sample(range(20_000), count)
    data = [(rng.choice(keys), START + timedelta(seconds=s), rng.randrange(4), rng.random() < 0.8) for s in seconds]
    return spark.createDataFrame(data, "key string, ts timestamp, value int, holds boolean")


@pytest.mark.parametrize("seed, keys", [(1, ("a", "b", "hot", "hot")), (2, (None, "a")), (3, ("one",))])
def test_previous_value_is_lag(spark, seed, keys):
    df = samples(spark, seed, keys=keys)
    got = ordering.previous_value(df, ["key"], ["ts"], "value", "previous")
    want = df.withColumn("previous", F.lag("value").over(Window.partitionBy("key").orderBy("ts")))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("seed, keys", [(4, ("a", "b", "hot", "hot")), (5, (None, "a"))])
def test_numbered_is_row_number(spark, seed, keys):
    df = samples(spark, seed, keys=keys)
    got = ordering.numbered(df, ["key"], ["ts"], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("ts")))
    assert rows(got, "key", "ts", "n") == rows(want, "key", "ts", "n")


def runs_by_loop(data):
    found = []
    for key in {row[0] for row in data}:
        run = []
        for _, ts, _, holds in sorted((row for row in data if row[0] == key), key=lambda row: row[1]):
            if holds:
                run.append(ts)
            elif run:
                found.append((key, run[0], run[-1], len(run)))
                run = []
        if run:
            found.append((key, run[0], run[-1], len(run)))
    return sorted(found, key=str)


@pytest.mark.parametrize("seed, keys", [(6, ("a", "b", "hot", "hot")), (7, ("one",)), (8, (None, "a"))])
def test_true_runs_cross_parts(spark, seed, keys):
    df = samples(spark, seed, keys=keys)
    got = ordering.true_runs(df, ["key"], "ts", "holds")
    found = [tuple(r) for r in got.select("key", "run_start", "run_end", "samples").collect()]
    assert sorted(found, key=str) == runs_by_loop([tuple(r) for r in df.collect()])


def test_true_runs_over_only_true_rows(spark):
    df = samples(spark, 10).withColumn("holds", F.lit(True))
    assert ordering.true_runs(df, ["key"], "ts", "holds").count() == 3


def spread(frame):
    """Rows per part, most first."""
    return sorted((r["count"] for r in frame.groupBy(ordering.PART).count().collect()), reverse=True)


def test_one_key_at_one_time_spans_tasks(spark):
    """A million rows of one key at one time lie in several parts of about equal size, and results are those of a plain window."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("hot").alias("key"), F.lit(START).alias("ts"), "id", (F.col("id") % 3).cast("int").alias("value"))
    sizes = spread(ordering.ranged(df, ["key"], ["ts", "id"]))
    assert len(sizes) == 4 and sizes[0] < 0.5 * n
    got = ordering.previous_value(df, ["key"], ["ts", "id"], "value", "previous")
    wrong = got.where(~F.col("previous").eqNullSafe(F.when(F.col("id") > 0, (F.col("id") - 1) % 3)))
    assert wrong.isEmpty() and got.count() == n
    assert ordering.numbered(df, ["key"], ["ts", "id"], "n").where("n != id + 1").isEmpty()
    same = df.select("key", "ts", "value")  # nothing tells the rows apart
    assert len(spread(ordering.ranged(same, ["key"], ["ts"]))) == 4
    numbers = ordering.numbered(same, ["key"], ["ts"], "n")
    assert dict(numbers.dtypes)["n"] == "bigint" and numbers.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first() == (1, n, n)


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, None), ("b", 5, "z")], "k string, o int, v string")
    assert rows(ordering.first_per_key(df, ["k"], ["o"])) == [("a", 1, None), ("b", 5, "z")]
    assert rows(ordering.last_per_key(df, ["k"], ["o"])) == [("a", 2, "x"), ("b", 5, "z")]


def test_pages_are_bounded_and_complete(spark):
    numbers = [n * n for n in range(1, 120)]  # uneven gaps
    df = spark.createDataFrame([("hot", n) for n in numbers] + [("small", 5000), ("small", 9000)], "k string, o long")
    pages = ordering.page_numbers(df, ["k"], "o", 10)
    paged = df.withColumn("block", ordering.page_block(F.col("o"), 10)).join(pages, ["k", "block"])
    sizes = {(r["k"], r["page"]): r["count"] for r in paged.groupBy("k", "page").count().collect()}
    assert sum(sizes.values()) == len(numbers) + 2
    assert max(sizes.values()) < 20
    assert sizes[("small", 0)] == 2
    ordered = [r["page"] for r in paged.where("k = 'hot'").orderBy("o").collect()]
    assert ordered == sorted(ordered)


def test_ordered_list_sorts_and_skips_nulls(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "o int, v string")
    assert df.agg(ordering.ordered_list(["o"], "v").alias("l")).first()["l"] == ["a", "c"]
