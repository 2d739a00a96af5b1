"""Centroid clustering by shallot search: exact rounds of k-means over integer vectors.

Every vector carries, from round to round, its centroid, the second-nearest one it remembers, an upper bound of its
distance to the first and a lower bound of its distance to any other. When centroids move, the bounds move with
them; a vector whose upper bound stays below the lower one (or below half the way to the nearest other centroid)
keeps its centroid unseen. The others measure both remembered centroids and start from the closer one: its
neighbours, sorted by distance, are scanned while they lie inside the ball of radius (distance to the
start) + (second-least distance so far), which shrinks with every better second. Candidates are compared by exact integer distances,
ties to the smaller number; bounds are only used with a margin for rounding, so the result is that of comparing all.

A round is one pass over vectors where they lie (Arrow batches, no shuffle), written to the shared folder with
its bounds, and one aggregate that sends k rows of partial sums per task; the round before is deleted. What tasks receive is k
centroids, their neighbour lists and moves: its size depends on k and the dimension alone.

Cases: vectors with another number of components, a null or non-finite one, or one beyond ``MOST`` after scaling (its squared
distance would not fit a long) are not kept and have no row. Fewer vectors than ``k`` give as many centroids; no vector
gives no rows. Rows that repeat an id or a vector each have their row; equal ids take start places in the order of their vectors.
A missing id hashes as an empty one. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.shipping import ship
from eventlake.session import discard, pinned

K = 40
ROUNDS = 5
DIMENSION = 64
SCALE = 256
SEED = 2
MOST = 1 << 26


def usable(embedding: Column, dimension: int, scale: int) -> Column:
    """Whether a vector is kept."""
    fits = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) * scale < float(MOST)), F.lit(False)))
    return F.coalesce((F.size(embedding) == dimension) & fits, F.lit(False))


def whole_vectors(vectors: DataFrame, dimension: int, scale: int, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): kept vectors in integers."""
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("x")).where(usable(F.col("x"), dimension, scale))
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = v - c
    return np.einsum("ij,ij->i", step, step)


@dataclass
class Ground:
    """Centroids of a round with their sorted neighbours and how far they came from the round before."""

    centroids: np.ndarray  # (k, dimension) int64
    order: np.ndarray  # (k, k): centroids by distance, itself first
    gaps: np.ndarray  # (k, k): these distances
    moved: np.ndarray
    farthest: np.ndarray  # the longest move of any other centroid

    @classmethod
    def of(cls, centroids: np.ndarray, before: np.ndarray | None = None) -> Ground:
        k = len(centroids)
        apart = np.stack([np.sqrt(squared(centroids, c).astype(np.float64)) for c in centroids])
        apart[np.arange(k), np.arange(k)] = -1.0
        order = np.argsort(apart, axis=1, kind="stable")
        moved = np.zeros(k) if before is None else np.sqrt(squared(centroids, before).astype(np.float64))
        farthest = np.array([np.delete(moved, c).max(initial=0.0) for c in range(k)])
        return cls(centroids, order, np.take_along_axis(apart, order, axis=1), moved, farthest)


def above(x: np.ndarray) -> np.ndarray:
    """Not less than the true value, whatever rounding did."""
    return x * (1 + 1e-12) + 1e-7


def below(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-12) - 1e-7


@dataclass
class Bounds:
    first: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def unbounded(n: int, k: int) -> Bounds:
    """Before the first round: nothing is known."""
    return Bounds(np.zeros(n, np.int64), np.full(n, min(1, k - 1), np.int64), np.full(n, np.inf), np.zeros(n))


def assign(v: np.ndarray, held: Bounds, ground: Ground) -> tuple[Bounds, int]:
    """Nearest centroids of a batch, and how many distances it took."""
    k = len(ground.centroids)
    if k == 1:
        return Bounds(np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.full(len(v), np.inf), np.zeros(len(v))), 0
    first, second = held.first.copy(), held.second.copy()
    upper, lower = above(held.upper + ground.moved[first]), below(held.lower - ground.farthest[first])
    least = np.maximum(lower, below(ground.gaps[first, 1] / 2))
    open_rows = np.flatnonzero(upper >= least)
    taken = len(open_rows)
    near = squared(v[open_rows], ground.centroids[first[open_rows]])
    upper[open_rows] = above(np.sqrt(near.astype(np.float64)))
    still = upper[open_rows] >= least[open_rows]
    rows, near = open_rows[still], near[still]
    own, far, near, far_by, seen = scan(v[rows], first[rows], second[rows], near, ground)
    first[rows], second[rows] = own, far
    upper[rows], lower[rows] = above(np.sqrt(near.astype(np.float64))), below(np.sqrt(far_by.astype(np.float64)))
    return Bounds(first, second, upper, lower), taken + seen


def scan(v: np.ndarray, first: np.ndarray, second: np.ndarray, first_by: np.ndarray, ground: Ground):
    """First and second nearest centroid and their squared distances, and how many distances it took."""
    second_by = squared(v, ground.centroids[second])
    swapped = (second_by < first_by) | ((second_by == first_by) & (second < first))
    best, next_best = np.where(swapped, second, first), np.where(swapped, first, second)
    best_by, next_by = np.where(swapped, second_by, first_by), np.where(swapped, first_by, second_by)
    start, known = best.copy(), next_best.copy()
    from_start = np.sqrt(best_by.astype(np.float64))
    inside, seen = np.arange(len(v)), len(v)
    for place in range(1, len(ground.centroids)):
        ball = above(from_start[inside] + np.sqrt(next_by[inside].astype(np.float64)))
        inside = inside[ground.gaps[start[inside], place] <= ball]
        if not len(inside):
            break
        candidate = ground.order[start[inside], place]
        fresh = candidate != known[inside]
        rows, candidate = inside[fresh], candidate[fresh]
        by = squared(v[rows], ground.centroids[candidate])
        seen += len(rows)
        wins = (by < best_by[rows]) | ((by == best_by[rows]) & (candidate < best[rows]))
        closer = ~wins & (by < next_by[rows])
        won = rows[wins]
        next_best[won], next_by[won] = best[won], best_by[won]
        best[won], best_by[won] = candidate[wins], by[wins]
        near = rows[closer]
        next_best[near], next_by[near] = candidate[closer], by[closer]
    return best, next_best, best_by, next_by, seen


STATE = "v array<long>, first int, second int, upper double, lower double"


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimension)


def assigned(state: DataFrame, ground: Ground, dimension: int, last: bool) -> DataFrame:
    """The state after one round; the last one gives (vec_id, cluster, distance) instead."""
    own = dict(state.dtypes)["vec_id"]
    fresh = "first" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), dimension)
            held = unbounded(len(v), len(ground.centroids)) if fresh else Bounds(
                batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy(), batch.column(5).to_numpy()
            )
            got, _ = assign(v, held, ground)
            first = pa.array(got.first, pa.int32())
            if last:
                by = pa.array(squared(v, ground.centroids[got.first]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), first, by], names=["vec_id", "cluster", "distance"])
            else:
                columns = [batch.column(0), batch.column(1), first, pa.array(got.second, pa.int32()), pa.array(got.upper), pa.array(got.lower)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "first", "second", "upper", "lower"])

    return state.mapInArrow(run, f"vec_id {own}, cluster int, distance long" if last else f"vec_id {own}, {STATE}")


def moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of the mean of every cluster; an empty one stays."""
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("first").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # k rows at most
        out[row.first] = [row[f"s{i}"] // row.n for i in range(centroids.shape[1])]
    return out


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    spark = vectors.sparkSession
    ship(spark)
    state = pinned(whole_vectors(vectors, dimension, scale, vec_id, embedding))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = state.orderBy(drawn, "v").limit(k).collect()  # k rows
    out = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    if not starts:
        return state.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)
    centroids, before = np.array([row.v for row in starts], dtype=np.int64), None
    for _ in range(rounds):
        moved = pinned(assigned(state, Ground.of(centroids, before), dimension, last=False))
        discard(state)
        state, before = moved, centroids
        centroids = moved_centroids(state, centroids)
    placed = pinned(assigned(state, Ground.of(centroids, before), dimension, last=True))
    discard(state)
    inertia = {row.cluster: row.inertia for row in placed.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), digests[c]) for c in range(len(centroids))]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(known), "cluster").select(*out.split(", "))  # k rows are sent


def sql(k: int = K, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in SQL: every distance of every round."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v AS m FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM v ORDER BY h, v LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        apart = "CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v, (least_one).c AS c, (least_one).d AS d FROM (SELECT vec_id, v, min(struct_pack(d := {apart}, c := c)) AS least_one FROM v, c{i} GROUP BY vec_id, v))")
        if i < rounds:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(m ORDER BY i) AS m FROM"
                f" (SELECT c, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM"
                f" (SELECT c, unnest(v) AS x, unnest(range({dimension})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c) n USING (c))"
            )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"
    )


SQL = sql()
