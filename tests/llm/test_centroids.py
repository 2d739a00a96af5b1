"""Shallot search against comparing everything."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlake.llm import centroids

VECTORS = "vec_id long, embedding array<double>"


def brute(rows, k, rounds, dimension, scale=256):
    """(vec_id, cluster, distance, cluster inertia, inertia, centroid hash) by comparing every vector with every centroid."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda row: (hashlib.sha256(f"2:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]))
    means = [v for _, v in start[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(means)):
            own = [v for (_, v), mine in zip(kept, of, strict=True) if mine == c]
            means[c] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else means[c]
    placed = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {c: sum(d for _, mine, d in placed if mine == c) for c in range(len(means))}
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in placed), key=str)


def got(spark, rows, **named):
    df = spark.createDataFrame(rows, VECTORS).withColumn("v", F.lit(1)).withColumn("cluster", F.lit("x")).withColumn("first", F.lit(2))
    return sorted((tuple(row) for row in centroids.cluster(df, **named).collect()), key=str)


@pytest.mark.parametrize(("n", "k", "dimension", "spread"), [(300, 12, 6, 1.0), (80, 40, 3, 0.01), (50, 1, 4, 1.0), (5, 9, 2, 1.0)])
def test_equals_brute_force(spark, n, k, dimension, spread):
    draw = np.random.default_rng(n)
    rows = [(i, (draw.normal(size=dimension) * spread + (i % 5)).tolist()) for i in range(n)]
    assert got(spark, rows, k=k, dimension=dimension) == brute(rows, k, 5, dimension)


def test_unusable_vectors_ties_and_repeats(spark):
    good = [(i, [float(i % 3), float(i % 2)]) for i in range(24)]  # many ties
    odd = [(100, None), (101, []), (102, [1.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, [1.0, 2.0, 3.0])]
    rows = [*good, (3, [0.0, 1.0]), (3, [2.0, -1.0]), (None, [0.5, 0.5]), (None, [0.5, 0.25]), *odd]
    assert got(spark, rows, k=7, dimension=2) == brute(rows, 7, 5, 2)


def test_empty_tables(spark):
    assert got(spark, [], dimension=2) == [] and got(spark, [(1, None)], dimension=2) == []
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@given(st.integers(2, 9), st.integers(1, 3), st.lists(st.tuples(st.integers(-6, 6), st.integers(-6, 6), st.integers(-2, 2)), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_bounds_and_ball_never_miss(k, rounds, points):
    """Rounds with bounds give the nearest centroid (least number of ties), whatever the centroids do in between."""
    v = np.array(points, dtype=np.int64)
    draw = np.random.default_rng(len(points))
    now, before, held = draw.integers(-6, 7, (k, 3)), None, centroids.unbounded(len(v), k)
    for _ in range(rounds + 1):
        held, _ = centroids.assign(v, held, centroids.Ground.of(now, before))
        every = ((v[:, None, :] - now[None]) ** 2).sum(axis=2)
        assert held.first.tolist() == every.argmin(axis=1).tolist()
        before, now = now, now + draw.integers(-1, 2, now.shape)


def test_search_is_pruned():
    draw = np.random.default_rng(3)
    middle = draw.normal(size=(40, 16)) * 3000
    v = np.rint(middle[draw.integers(0, 40, 4000)] + draw.normal(size=(4000, 16)) * 300).astype(np.int64)
    now = np.rint(middle).astype(np.int64)
    held, first = centroids.assign(v, centroids.unbounded(len(v), 40), centroids.Ground.of(now))
    _, later = centroids.assign(v, held, centroids.Ground.of(now + 5, now))
    assert first < 40 * len(v) and later < 0.05 * 40 * len(v)
