"""Memory of fitting the toxicity model: pairs of words are counted a share at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from eventlake.llm import tokens, toxicity


def some_lessons(texts: int, words: int, vocabulary: int) -> tuple[toxicity.Lessons, np.ndarray]:
    rng = np.random.default_rng(3)
    drawn = rng.integers(0, vocabulary, (texts, words))
    column = pa.array([" ".join(f"w{x}" for x in row) for row in drawn], pa.string())
    return toxicity.lessons_of(tokens.pieces(column, tokens.MARKS, lower=True)), np.arange(texts) % 2 > 0


def test_counting_pairs_takes_few_bytes_a_word():
    lessons, toxic = some_lessons(400, 3000, 2000)
    tracemalloc.start()
    try:
        toxicity.tables(lessons.texts, toxic, lessons)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 60 * sum(map(len, lessons.texts))


def test_shares_change_no_result(monkeypatch):
    lessons, toxic = some_lessons(120, 200, 20)
    whole = toxicity.tables(lessons.texts, toxic, lessons)
    monkeypatch.setattr(toxicity, "SHARE", 100, raising=False)
    parts = toxicity.tables(lessons.texts, toxic, lessons)
    assert len(whole.pairs)
    for name in ("nodes", "low", "left", "total", "open", "pairs", "count"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name


def test_words_are_numbered_alike_over_pieces(monkeypatch):
    whole, _ = some_lessons(20, 100, 300)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 700)
    parts, _ = some_lessons(20, 100, 300)
    assert np.array_equal(whole.known, parts.known) and np.array_equal(whole.stems, parts.stems)
    assert all(map(np.array_equal, whole.texts, parts.texts))
    assert {len(x) for x in parts.texts} == {100}
