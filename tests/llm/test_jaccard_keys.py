"""Keys of sets: how many rows they make, and that weak ones are left out."""

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from plain import words

from eventlake.llm import jaccard_join


@pytest.mark.parametrize("threshold", [Fraction(4, 5), Fraction(9, 10), Fraction(7, 10)])
def test_linked_sets_share_a_key_at_the_bound(threshold):
    rng = np.random.default_rng(8)
    edges = jaccard_join.band_edges(threshold, 1 << 30)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    linked = 0
    for _ in range(1500):
        base = draw(int(rng.integers(1, 400)))
        lost = rng.integers(0, int(len(base) * (1 - threshold)) + 2)
        spare = int(max(0, (len(base) - lost) / threshold - len(base)))  # about as many as the threshold leaves room for
        other = np.unique(np.concatenate([rng.permutation(base)[lost:], draw(int(rng.choice([0, spare, rng.integers(0, spare + 1)])))]))
        if len(other) and len(np.intersect1d(base, other)) >= threshold * len(np.union1d(base, other)):
            linked += 1
            assert np.intersect1d(*[jaccard_join.part_keys(x, edges, threshold) for x in (base, other)]).size
    assert linked > 300


def test_one_common_shingle_in_large_sets_rarely_is_a_key():
    """At 4/5 every tenth part would hold one shingle alone, and sets with a common one would meet."""
    rng, threshold = np.random.default_rng(3), Fraction(4, 5)
    edges = jaccard_join.band_edges(threshold, 1 << 30)
    common = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 300).astype(np.uint64)])) for _ in range(60)]
    keys = [jaccard_join.part_keys(x, edges, threshold) for x in sets]
    met = sum(np.intersect1d(a, b).size > 0 for i, a in enumerate(keys) for b in keys[:i])
    assert met < 0.02 * 60 * 59 / 2


def test_least_document_of_equal_sets_has_the_keys():
    batch = pa.RecordBatch.from_arrays([pa.array([7, 3, 9]), pa.array([words(20)] * 2 + [words(20, 100)])], names=["doc_id", "text"])
    rows = pa.Table.from_batches(jaccard_join.meetings(3, Fraction(9, 10))(iter([batch]))).to_pylist()
    assert {row["doc_id"] for row in rows if not row["met"]} == {3, 9}
    assert [(row["place"], row["doc_id"]) for row in rows if row["met"]] == [(3, 7)]


def test_scratch_of_the_join_is_deleted(spark, documents, monkeypatch):
    """What is left below the shared folder is what the lazy result reads."""
    made, gone = [], []
    keep, drop = jaccard_join.pinned, jaccard_join.discard
    monkeypatch.setattr(jaccard_join, "pinned", lambda df: made.append(keep(df)) or made[-1])
    monkeypatch.setattr(jaccard_join, "discard", lambda *frames: gone.extend(frames) or drop(*frames))
    out = jaccard_join.linked_components(documents((0, words(40)), (1, words(40)), (2, words(39)), (3, None)))
    assert {row.doc_id: row.component_id for row in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    assert len([frame for frame in made if all(frame is not x for x in gone)]) == 2
