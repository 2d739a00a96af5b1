"""Connected components by contraction, in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.session import discard, pinned


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that ``edges`` (a, b) names; ``component`` is the least node reachable.

    Each round hooks every node to its least smaller neighbour, follows hooks to their roots by doubling,
    and replaces edges by edges of the roots; nodes with edges at least halve per round. A hub with
    many neighbours is one row after the aggregates, and the joins back are split by adaptive execution.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    open_edges = pinned(edges.dropna(subset=["a", "b"]).select(low.alias("a"), high.alias("b")).where("a < b").distinct())
    hooks, made = [], [open_edges]
    while not open_edges.isEmpty():
        hook = pinned(open_edges.groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("node"), F.col("a").alias("up")))
        made.append(hook)
        climbing = True
        while climbing:  # doubles the height of a hook until all end at roots
            upper = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            doubled = pinned(hook.join(upper, "up", "left").select("node", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")))
            discard(made.pop())  # the hooks before
            made.append(doubled)
            climbing = not doubled.where("moved").isEmpty()
            hook = doubled.select("node", "up")
        hooks.append(hook)
        moved = open_edges.join(hook.select(F.col("node").alias("b"), F.col("up").alias("b_up")), "b")
        moved = moved.join(hook.select(F.col("node").alias("a"), F.col("up").alias("a_up")), "a", "left")
        ends = moved.select(F.coalesce("a_up", "a").alias("x"), F.col("b_up").alias("y"))
        open_edges = pinned(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
        made.append(open_edges)
    roots = None
    for hook in reversed(hooks):  # later rounds say where the hooks of earlier ones end
        if roots is not None:
            onward = roots.select(F.col("node").alias("up"), F.col("component").alias("onward"))
            hook = hook.join(onward, "up", "left").select("node", F.coalesce("onward", "up").alias("up"))
        settled = hook.select("node", F.col("up").alias("component"))
        if roots is not None:
            settled = pinned(roots.unionByName(settled))
            made.append(settled)
        roots = settled
    if roots is None:
        discard(*made)
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    tops = roots.select(F.col("component").alias("node"), "component").distinct()
    out = pinned(roots.unionByName(tops))
    discard(*made)
    return out
