"""The copy stage against all pairs, at five words and 0.8."""

import random
from fractions import Fraction

import numpy as np
from plain import split, words

import corpus_pipeline
from eventlake.llm import jaccard_join


def shingles(text, k=5):
    w = split(text, lower=True)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def kept(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        return i if up[i] == i else top(up[i])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i for i in sets if top(i) == i}


def edited(text, *places):
    return " ".join(f"e{i}" if i in places else w for i, w in enumerate(text.split()))


def test_families_beyond_a_tile(spark, documents, monkeypatch):
    """Families that glue together and need the pairs by key: the same groups, however small tiles are."""
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 7)
    rng = random.Random(9)
    base = words(120).split()
    rows = []
    for i in range(90):  # a walk away from the base: neighbours are alike, far ones are not
        for _ in range(rng.randrange(1, 3)):
            base[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    rng.shuffle(rows)
    got = {row.doc_id for row in corpus_pipeline.drop_copies(spark, documents(*rows), "").collect()}
    assert got == kept(rows)


def test_copies_at_five_words(spark, documents):
    rng = random.Random(4)
    rows = [(0, words(100)), (1, edited(words(100), 30, 60)), (2, words(50, 1000)), (3, edited(words(50, 1000), 20)), (4, edited(words(50, 1000), 10, 40)), (5, "a b"), (6, "A b"), (7, None), (8, "")]
    for start in range(20, 320, 10):
        n = rng.randrange(8, 300)
        rows += [(start + i, edited(words(n, 10000 * start), *(rng.randrange(n) for _ in range(rng.randrange(n // 25 + 2))))) for i in range(6)]
    got = {row.doc_id for row in corpus_pipeline.drop_copies(spark, documents(*rows), "").collect()}
    assert got == kept(rows) and 0 in got and not got & {1, 3}


def test_sets_at_four_fifths_share_a_key_and_others_do_not():
    rng, threshold = np.random.default_rng(6), Fraction(4, 5)
    edges = jaccard_join.band_edges(threshold, 1 << 30)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    keys = lambda s: set(jaccard_join.part_keys(s, edges, threshold).tolist())
    for _ in range(600):
        n = int(rng.integers(1, 250))
        base = draw(n)
        lost = int(rng.integers(0, n // 5 + 1))
        other = np.unique(np.concatenate([base[: n - lost], draw(int(rng.integers(0, n // 4 + 1)))]))
        if 5 * len(np.intersect1d(base, other)) >= 4 * len(np.union1d(base, other)):
            assert keys(base) & keys(other)
    apart = [keys(draw(300)) for _ in range(100)]
    assert sum(len(a & b) > 0 for i, a in enumerate(apart) for b in apart[:i]) == 0
