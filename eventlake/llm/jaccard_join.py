"""N-gram Jaccard join: exact links between documents whose shingle sets are alike, and their components.

Candidates come from size-banded tiles. Set sizes are cut into bands so that two sets at the
threshold lie in one band or in neighbouring ones; tile ``t`` compares sets whose smaller one lies in
band ``t``. Two such sets differ in at most ``D`` shingles, so if the hash space is cut into ``D + 1`` parts, at
least one part holds the same shingles of both (pigeonhole). Each set therefore stands in its tiles
under one key per part, the hash of what the part holds, and no link is missed; a part holds about
ten shingles at 9/10, so sets that are not near copies hardly ever meet, however common their shingles are. Below 9/10 parts hold
fewer (about three at 4/5), some one or none, so that any common shingle would make sets meet; then there are spare parts. A set leaves its
emptiest parts out as long as more are left than differing shingles can touch (``part_keys``).

Sets that meet, directly or through others, form families. Inside a family, sets are ordered by
size, and a pair is compared only within the size bound and while it is not connected yet. A hashed
bitmap (parity of the shingles per bit) bounds the overlap from above: every differing bit is a
differing shingle. Only pairs that pass the bound meet in an exact intersection of the sorted sets.

Equal sets stand for one. A family beyond ``TILE`` sets is spread over tiles, each with its share of the family and
about ``PIVOTS`` common pivots, which connects most of it in work linear in its size. What is then still in several
components is settled by keys: linked sets share one, so only sets of different components that share a key are paired, as
(size, bitmap): first every set with the first and the last one of its keys, then, by key, those outside the
key's largest component with all of it; keys of more than ``MARK_TILE`` sets are cut into tiles. Texts are fetched for the pairs that pass the bounds.

Cases: texts without words (null, empty) have an empty set and link with nothing; fewer words than a
shingle are one shingle. Rows without an id link with nothing and have no component; rows of one
id are one node, repeated rows give repeated results. An empty table gives no rows; further
columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm import tokens
from eventlake.llm.graph import components
from eventlake.llm.shipping import ship
from eventlake.session import discard, pinned

SHINGLE = 3
THRESHOLD = Fraction(9, 10)
TILE = 128
PIVOTS = 16
CELL_ROWS = 2000
MARK_TILE = 1024  # sets of a key that meet as (size, bitmap)
BITS = 1024
FLUSH_KEYS = 1 << 20
ARROW_ROWS = 1 << 16


def shingle_sets(piece: tokens.Piece, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every document of a piece."""
    every = tokens.runs(piece.hashes, k)
    for start, end in zip(piece.first[:-1], piece.first[1:], strict=True):
        if end - start >= k:
            yield np.unique(every[start : end - k + 1])
        else:
            yield tokens.runs(piece.hashes[start:end], end - start, salt=int(end - start)) if end > start else every[:0]


def band_edges(threshold: Fraction, largest: int) -> np.ndarray:
    """Least sizes of the bands: the next band starts at the first size that no set of a band below can reach."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * threshold.denominator // threshold.numerator + 1)
    return np.array(edges, dtype=np.int64)


def tile_parts(edges: np.ndarray, threshold: Fraction, tile: int) -> int:
    """One more than the most shingles by which two linked sets of a tile can differ."""
    small = int(edges[tile + 1]) - 1
    large = small * threshold.denominator // threshold.numerator
    return (small + large) * (threshold.denominator - threshold.numerator) // (threshold.denominator + threshold.numerator) + 1


def spare_parts(parts: int, threshold: Fraction) -> int:
    """Parts beyond those that are needed, so that enough of them hold two shingles where they hold few."""
    return parts * 3 // 8 + 3 if threshold < Fraction(9, 10) else 0


def part_keys(hashes: np.ndarray, edges: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Keys of a set in its own tile and the one below.

    The parts are left out that hold fewer shingles than the ``needed``-th fullest one: those kept are more than the differing
    shingles can touch, so one of them is the same in any linked set, which keeps it too, as of two linked sets that with
    the higher bound has its kept parts among those the other keeps where they are the same."""
    num, den = threshold.numerator, threshold.denominator
    band = int(np.searchsorted(edges, len(hashes), "right")) - 1
    keys = []
    spread = tokens.mixed(hashes + np.uint64(tokens.STEP))
    for tile in (band, band - 1) if band else (band,):
        most = tile_parts(edges, threshold, tile)
        parts = np.uint64(most + spare_parts(most, threshold))
        other = len(hashes) * den // num if tile == band else int(edges[band]) - 1  # the largest set it can link with here
        needed = (len(hashes) + other) * (den - num) // (den + num) + 1
        content = np.zeros(int(parts), dtype=np.uint64)
        part = (spread % parts).astype(np.int64)
        np.add.at(content, part, hashes)
        of_tile = tokens.mixed(content + tokens.mixed(np.arange(int(parts), dtype=np.uint64) + np.uint64((tile + 1) << 40)))
        held = np.bincount(part, minlength=int(parts))
        keys.append(of_tile[held >= np.sort(held)[-needed]])
    return np.concatenate(keys)


SIZES = "doc_id long, n long, high long, low long"


def set_hashes(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    return tokens.mixed(hashes).sum(), tokens.mixed(hashes ^ np.uint64(tokens.STEP)).sum()


def sizes(k: int):
    """Size and hash of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low = [], [], []
            for piece in tokens.pieces(batch.column(1), lower=True):
                for hashes in shingle_sets(piece, k):
                    one, two = set_hashes(hashes)
                    n.append(len(hashes))
                    high.append(one)
                    low.append(two)
            numbers = [pa.array(n, pa.int64()), *[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers], names=["doc_id", "n", "high", "low"])

    return run


MEETINGS = "place long, doc_id long, met boolean"


def meetings(k: int, threshold: Fraction):
    """(key, document, false) for every key of a set, and (document, document, true) for two of equal sets.

    A set that came before in a task has no keys of its own: it meets the one that stands for it, that of the least number."""
    edges = band_edges(threshold, 1 << 40)

    def flush(ids: list[int], keys: list[np.ndarray], equals: list[int]) -> Iterator[pa.RecordBatch]:
        numbers = np.array(ids, dtype=np.int64)
        copies = np.array([(row, earlier) for row, earlier in enumerate(equals) if earlier >= 0], dtype=np.int64).reshape(-1, 2).T
        met = np.unique(numbers[copies], axis=1)
        met = met[:, met[0] != met[1]]
        owners = np.repeat(numbers, [len(x) for x in keys])
        places, documents = np.concatenate([np.concatenate(keys).view(np.int64), met[1]]), np.concatenate([owners, met[0]])
        kinds = np.arange(len(places)) >= len(owners)
        for begin in range(0, len(places), ARROW_ROWS):
            part = slice(begin, begin + ARROW_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(places[part]), pa.array(documents[part]), pa.array(kinds[part])], names=["place", "doc_id", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_keys, seen = ([], [], []), 0, {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for piece in tokens.pieces(batch.column(1), lower=True):
                for row, hashes in zip(piece.rows, shingle_sets(piece, k), strict=True):
                    if not len(hashes) or ids[row] is None:
                        continue
                    before = seen.setdefault(set_hashes(hashes), len(held[0]))
                    fresh = before == len(held[0])
                    keys = part_keys(hashes, edges, threshold) if fresh else hashes[:0]
                    number = ids[row]
                    if not fresh and number < held[0][before]:
                        number, held[0][before] = held[0][before], number
                    for column, value in zip(held, (number, keys, -1 if fresh else before), strict=True):
                        column.append(value)
                    n_keys += len(keys)
                if n_keys > FLUSH_KEYS:
                    yield from flush(*held)
                    held, n_keys, seen = ([], [], []), 0, {}
        if held[0]:
            yield from flush(*held)

    return run


def bitmap(hashes: np.ndarray) -> np.ndarray:
    bits = np.bincount((tokens.mixed(hashes) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def links(sets: list[np.ndarray], threshold: Fraction, left: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect the sets, a spanning part of all links. Pairs without a ``left`` set are not compared."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], dtype=np.int64)
    bits = np.stack([bitmap(sets[i]) for i in order])
    left, group = left[order], np.arange(len(order))
    num, den = threshold.numerator, threshold.denominator
    for i in range(len(order)):
        upto = int(np.searchsorted(sizes, sizes[i] * den // num, "right"))
        later = np.arange(i + 1, upto)
        later = later[(group[later] != group[i]) & (left[i] | left[later])]
        if not len(later):
            continue
        differing = np.bitwise_count(bits[later] ^ bits[i]).sum(axis=1)
        total = sizes[later] + sizes[i]
        overlap = (total - differing) // 2  # no more than this can be shared
        for j in later[den * overlap >= num * (total - overlap)]:
            if group[j] == group[i]:
                continue
            shared = len(np.intersect1d(sets[order[i]], sets[order[j]], assume_unique=True))
            if den * shared >= num * (sizes[i] + sizes[j] - shared):
                yield int(order[i]), int(order[j])
                group[group == group[j]] = group[i]


LINKS = "a long, b long"


def compare(k: int, threshold: Fraction):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        sets = [x for piece in tokens.pieces(table.column("text"), lower=True) for x in shingle_sets(piece, k)]
        left = table.column("left_side").to_numpy().astype(bool)
        found = [(ids[i], ids[j]) for i, j in links(sets, threshold, left)] if sets else []
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return run


def linked_components(docs: DataFrame, k: int = SHINGLE, threshold: Fraction = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    ship(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    brief = pinned(given.mapInArrow(sizes(k), SIZES))
    classes = pinned(brief.where("doc_id is not null and n > 0").groupBy("high", "low").agg(F.min("doc_id").alias("rep")))

    # Keys that several sets have, with all of these, by one shuffle; rows of a document travel side by side, so they compress.
    rows = given.mapInArrow(meetings(k, threshold), MEETINGS).repartition("place", "met")
    of_place = Window.partitionBy("place", "met")
    rows = rows.withColumns({"first": F.min("doc_id").over(of_place), "last": F.max("doc_id").over(of_place)})
    met = pinned(rows.where(F.col("met") | (F.col("first") < F.col("last"))).drop("last"))
    # Families of sets that meet in a key.
    pairs = met.where(F.col("met") | (F.col("doc_id") != F.col("first")))
    families = components(pairs.select(F.when(F.col("met"), F.col("place")).otherwise(F.col("first")).alias("a"), F.col("doc_id").alias("b")))
    sets = families.join(classes.select(F.col("rep").alias("node")), "node", "left_semi")
    family_sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = sets.join(family_sizes, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("family"), "size")
    texts = pinned(given.join(members.hint("merge"), "doc_id"))

    shared = met.where(~F.col("met")).select(F.col("place").alias("key"), "doc_id")
    in_tiles = components(_links_in_tiles(texts, k, threshold))
    connected = settled(texts, in_tiles, shared, k, threshold)

    by_set = pinned(classes.join(connected.withColumnRenamed("node", "rep"), "rep", "left").select("high", "low", F.coalesce("component", "rep").alias("component")))
    discard(classes, met, families, texts, in_tiles, *([] if connected is in_tiles else [connected]))  # brief and by_set hold the result
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return brief.select("doc_id", "n", "high", "low").join(by_set, ["high", "low"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")
    )


def _links_in_tiles(texts: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Links inside every tile of a family; a large family has several tiles, each with the family's pivots."""
    tiles = F.ceil(F.col("size") / TILE)
    own = F.pmod(F.xxhash64("doc_id"), tiles)
    pivot = F.pmod(F.xxhash64("doc_id", F.lit("pivot")), F.ceil(F.col("size") / PIVOTS)) == 0  # about PIVOTS sets of the family
    every = F.when((tiles > 1) & pivot, F.sequence(F.lit(0).cast("long"), tiles - 1)).otherwise(F.array(own))
    placed = texts.select("doc_id", "text", "family", F.explode(every).alias("tile"), F.lit(True).alias("left_side"))
    return placed.groupBy("family", "tile").applyInArrow(compare(k, threshold), LINKS)


MARKS = "doc_id long, n long, bits binary"
PAIRS = "a long, b long, bound long"


def marks(k: int):
    """Size and bitmap of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tokens.pieces(batch.column(1), lower=True):
                sets = list(shingle_sets(piece, k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(piece.rows)), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x).tobytes() for x in sets], pa.binary()),
                ], names=["doc_id", "n", "bits"])

    return run


def bounded_pairs(threshold: Fraction):
    """Pairs of one cell that share a key, lie in different components, and pass the size and bit-count bounds.

    Rows of the left side meet all rows of the right side under their key; a row can be on both."""
    num, den = threshold.numerator, threshold.denominator

    def run(table: pa.Table) -> pa.Table:
        key, node, component, n, left, right = [table.column(name).to_numpy() for name in ("key", "doc_id", "component", "n", "left_side", "right_side")]
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(len(key), -1)
        order = np.argsort(key, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1, [len(order)]])
        found = {}
        for begin, behind in zip(cuts[:-1], cuts[1:], strict=True):
            members = order[begin:behind]
            lefts, rights = members[left[members]], members[right[members]]
            for one in lefts:
                fits = (component[rights] != component[one]) & (np.maximum(n[rights], n[one]) * num <= np.minimum(n[rights], n[one]) * den)
                others = rights[fits]
                total = n[others] + n[one]
                overlap = (total - np.bitwise_count(bits[others] ^ bits[one]).sum(axis=1).astype(np.int64)) // 2  # no more than this can be shared
                passed = den * overlap >= num * (total - overlap)
                for other, share in zip(node[others[passed]], overlap[passed] * 1_000_000 // total[passed], strict=True):
                    found[int(min(node[one], other)), int(max(node[one], other))] = int(share)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64()), "bound": pa.array(found.values(), pa.int64())})

    return run


def verified(k: int, threshold: Fraction):
    """Exact intersections of (a, b, text of a, text of b)."""
    num, den = threshold.numerator, threshold.denominator

    def sets_of(column: pa.Array) -> list[np.ndarray]:
        return [x for piece in tokens.pieces(column, lower=True) for x in shingle_sets(piece, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for one, two in zip(sets_of(part.column(2)), sets_of(part.column(3)), strict=True):
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    linked.append(den * shared >= num * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def passing(threshold: Fraction):
    """Whether pairs (a, b, sizes and bitmaps of both) pass the size and bit-count bounds."""
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint64).reshape(len(one), -1) for i in (4, 5)]
            overlap = np.minimum((one + two - np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1).astype(np.int64)) // 2, np.minimum(one, two))
            passed = pa.array(den * overlap >= num * (one + two - overlap))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(passed), batch.column(1).filter(passed)], names=["a", "b"])

    return run


def settled(texts: DataFrame, connected: DataFrame, shared: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """Components once every pair of sets that shares a key and may link has been compared or connected.

    ``shared`` holds (key, doc_id) for all keys of several sets.
    First every set meets the first and the last set of each of its keys, which is linear and connects most; then
    what shares a key and still lies in different components."""
    large = texts.where(F.col("size") > TILE).select("doc_id", "family").distinct()
    placed = large.join(connected.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    several = placed.groupBy("family").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    labels = pinned(placed.join(several.select("family"), "family", "left_semi").select("doc_id", "component"))
    if labels.isEmpty():
        discard(labels)
        return connected
    own = texts.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"])
    marked = pinned(own.mapInArrow(marks(k), MARKS))
    # Sets that share a key are of one family, so these rows hold all of a key; repeated rows of a document are one.
    shared = pinned(shared.join(labels.select("doc_id"), "doc_id", "left_semi").distinct())
    made = [labels, marked, shared]
    edges = connected.select(F.col("node").alias("a"), F.col("component").alias("b"))
    tested, pairs = None, None
    for step in ("leaders", "best", "rest"):
        if step == "leaders":
            pairs = _with_leaders(shared, marked, labels, threshold, made)
        elif step == "best":
            pairs = pinned(_bounded(shared, marked, labels, threshold, made))
            made.append(pairs)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        left, right = labels.select(F.col("doc_id").alias("a"), F.col("component").alias("of_a")), labels.select(F.col("doc_id").alias("b"), F.col("component").alias("of_b"))
        still = pairs.join(left, "a").join(right, "b").where("of_a != of_b")
        if step == "best":
            still = still.groupBy("a", "of_b").agg(F.max(F.struct("bound", "b")).alias("best")).select("a", "best.b")
        first, second = own.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), own.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
        compared = still.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")
        judged = pinned(compared.mapInArrow(verified(k, threshold), "a long, b long, linked boolean"))
        tested = judged.select("a", "b") if tested is None else tested.unionByName(judged.select("a", "b"))
        edges = edges.unionByName(judged.where("linked").select("a", "b"))
        connected = components(edges)
        merged = labels.select("doc_id").join(connected.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
        labels = pinned(merged)
        made += [judged, labels, connected]
    made.remove(connected)
    discard(*made)
    return connected


def _with_leaders(shared: DataFrame, marked: DataFrame, labels: DataFrame, threshold: Fraction, made: list | None = None) -> DataFrame:
    """Distinct pairs of a set and the first or last set of one of its keys, in other components, that pass the bounds.

    Sets of many keys mostly have the same leaders under all of them, so components are looked up by pair, not by key."""
    of_key = Window.partitionBy("key")
    ends = pinned(shared.select("doc_id", F.min("doc_id").over(of_key).alias("first"), F.max("doc_id").over(of_key).alias("last")).distinct())
    if made is not None:
        made.append(ends)
    led = ends.select("doc_id", F.col("first").alias("lead")).unionByName(ends.select("doc_id", F.col("last").alias("lead"))).where("doc_id != lead")
    pairs = led.select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct()
    own = marked.join(labels, "doc_id")
    one = own.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"), F.col("component").alias("of_a"))
    two = own.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"), F.col("component").alias("of_b"))
    both = pairs.join(one, "a").join(two, "b").where("of_a != of_b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return both.mapInArrow(passing(threshold), "a long, b long")


def _bounded(shared: DataFrame, marked: DataFrame, labels: DataFrame, threshold: Fraction, made: list | None = None) -> DataFrame:
    """Pairs by shared key. Of two sets in different components one lies outside the key's largest component: only
    those outside are the left side, so work for a key is linear in its size as long as they are few. Keys of more
    than ``MARK_TILE`` sets are cut into tiles of both sides; others share a cell, where a set is one row for both sides."""
    rows = shared.join(labels, "doc_id")
    counted = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("own"))
    mixed = counted.groupBy("key").agg(
        F.sum("own").alias("sets"), F.max(F.struct("own", "component")).alias("main"), F.count(F.lit(1)).alias("components")
    ).where("components > 1")
    mixed = pinned(mixed.select("key", "sets", (F.col("sets") - F.col("main.own")).alias("outside"), F.col("main.component").alias("main")))
    if made is not None:
        made.append(mixed)
    cells = int(mixed.agg(F.sum("sets")).first()[0] or 0) // CELL_ROWS + 1
    left_tiles, tiles = F.ceil(F.col("outside") / MARK_TILE), F.ceil(F.col("sets") / MARK_TILE)
    members = rows.join(mixed, "key")
    kept = ["doc_id", "component", "key", F.when(tiles > 1, F.col("key")).otherwise(F.pmod("key", F.lit(cells))).alias("place")]
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    lefts = members.where((F.col("component") != F.col("main")) & (tiles > 1)).select(
        *kept, F.pmod(F.xxhash64("doc_id", F.lit("left")), left_tiles).alias("i"), every(tiles).alias("j"), F.lit(True).alias("left_side"), F.lit(False).alias("right_side")
    )
    rights = members.select(
        *kept, every(left_tiles).alias("i"), F.pmod(F.xxhash64("doc_id", F.lit("right")), tiles).alias("j"),
        ((F.col("component") != F.col("main")) & (tiles == 1)).alias("left_side"), F.lit(True).alias("right_side"),
    )
    sides = lefts.unionByName(rights).join(marked, "doc_id")  # bitmaps are fetched for what is left
    return sides.groupBy("place", "i", "j").applyInArrow(bounded_pairs(threshold), PAIRS).groupBy("a", "b").agg(F.max("bound").alias("bound"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i) WHERE len(words) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)
), both_ways AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""
