"""Links and components against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest
from plain import split

from eventlake.llm import graph, jaccard_join


def shingles(text):
    words = split(text, lower=True)
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else ({tuple(words)} if words else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def family(rng, n, length, edits, start):
    base = [f"b{start}_{i}" for i in range(length)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        rows.append((start + i, " ".join(text)))
    return rows


@pytest.mark.parametrize("tile", [512, 8])
def test_against_all_pairs(documents, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "PIVOTS", max(tile // 4, 2))
    rng = random.Random(tile)
    rows = [*family(rng, 60, 120, 4, 0), *family(rng, 12, 30, 1, 100), *family(rng, 12, 300, 9, 200)]
    rows += [(300, "a b"), (301, "A\tb"), (302, "a"), (303, None), (304, ""), (305, "a b c"), (306, "a b c"), (307, " ".join(["x"] * 50)), (308, "x x x"), (309, " ".join(f"q{i}" for i in range(20000)))]
    rng.shuffle(rows)
    got = {row.doc_id: (row.n_shingles, row.component_id) for row in jaccard_join.linked_components(documents(*rows)).collect()}
    assert got == brute(rows)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(5)
    threshold, edges = Fraction(9, 10), jaccard_join.band_edges(Fraction(9, 10), 1 << 30)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        most = len(one) // 10
        other = np.unique(np.concatenate([one[: len(one) - int(rng.integers(0, most + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, most + 1))).astype(np.uint64)]))
        shared = len(np.intersect1d(one, other))
        if 10 * shared >= 9 * (len(one) + len(other) - shared):
            assert set(jaccard_join.part_keys(one, edges, threshold).tolist()) & set(jaccard_join.part_keys(other, edges, threshold).tolist())


def test_odd_rows(documents):
    assert jaccard_join.linked_components(documents()).count() == 0
    got = jaccard_join.linked_components(documents((2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (1, "a b c d"))).collect()
    assert sorted((row.doc_id or 0, row.component_id or 0) for row in got) == [(0, 0), (1, 1), (2, 1), (2, 1)]


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(None, 3)]
    up = {}

    def top(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges[:-1]:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {row.node: row.component for row in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for i in up}
