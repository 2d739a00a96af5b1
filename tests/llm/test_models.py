"""Learned operators: held-out accuracy, exact digests, odd rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from plain import split

from eventlake.llm import language_model, quality, toxicity

INSULTS = ["dolt", "oaf", "lout"]


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    common = [f"{a}{b}" for a in "bcdfgl" for b in ("ana", "ert", "ion", "ust", "oru")]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 120))]
        toxic, good = rng.random() < 0.25, rng.random() < 0.8
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        text = " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_toxicity(spark, documents, labelled):
    rows, labels = labelled
    frame = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1), (2, 1, 7)], "doc_id long, quality int, toxic int")
    got = {row.doc_id: row for row in toxicity.judge(documents(*rows, (9000, None), (9001, "")), frame).collect()}
    held = [(got[i].predicted, toxic) for i, _, toxic in labels if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in labels)
    assert np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.3) for row in got.values())
    assert got[9000].score == got[9001].score and len(got) == len(rows) + 2


def test_toxicity_without_lessons(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [row.score for row in toxicity.judge(documents((1, "a"), (1, "a"), (None, "b")), none).collect()] == [0.5] * 3
    clean = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality int, toxic int")
    assert toxicity.judge(documents((1, "a")), clean).first().score == 0
    assert toxicity.judge(documents(), clean).count() == 0


def test_quality(spark, documents, labelled):
    rows, labels = labelled
    frame = spark.createDataFrame([*labels, (1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {row.doc_id: row for row in quality.select(documents(*rows, (9000, None), (9001, "")), frame).collect()}
    held = [(i, good, toxic) for i, good, toxic in labels if got[i].held_out]
    assert np.mean([got[i].keep == bool(good) for i, good, _ in held]) > 0.97
    mean = lambda good, toxic: np.mean([got[i].expected_grade for i, g, t in held if (g, t) == (good, toxic)])
    assert mean(0, 0) < mean(1, 1) < mean(1, 0)
    assert got[9000].expected_grade == got[9001].expected_grade


def test_quality_thresholds_rise():
    model = quality.fit(["a b", "c d", "e f", "g h"] * 10, [0, 1, 2, 3] * 10)
    assert list(model.grades) == [0, 1, 2, 3] and (np.diff(model.thresholds) > 0).all()


def test_quality_without_lessons(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    row = quality.select(documents((1, "a"), (None, None)), none).first()
    assert (row.expected_grade, row.keep) == (0.0, False)


@pytest.fixture
def short_training(monkeypatch):
    monkeypatch.setattr(language_model, "ROUNDS", 60)


def test_language_model(documents, labelled, short_training):
    rows, _ = labelled
    got = {row.doc_id: row for row in language_model.score_texts(documents(*rows, (9000, None), (9001, ""), (None, "Bana x9"))).collect()}
    tokens = {i: [*split(text, lower=True), "\0"] for i, text in [*rows, (9000, ""), (9001, ""), (None, "Bana x9")]}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter(t for i, ts in tokens.items() if not held(i) for t in ts)
    total = sum(count.values())
    for i, ts in tokens.items():
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (len(count) + 1))) for t in ts)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(ts), sum(count[t] > 0 for t in ts), total, held(i))
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0
    fresh = [row for row in got.values() if row.held_out]
    assert sum(row.score for row in fresh) > sum(row.base_score for row in fresh)


def test_language_model_probabilities_sum_to_one(short_training):
    """Over all words of the corpus, unseen words left aside, and the end."""
    model = language_model.learn(["a b c a b", "b c d", "a d"], language_model.TOKENIZER)
    place = np.array([0, 1])
    vectors = model.embed[[1, 2]]
    total = 0.0
    for goal in range(language_model.CLASSES):
        # Class of the first word, whatever follows: its share is read off a text that starts with it.
        scores = language_model.class_scores(model.tables, vectors, place, np.array([goal, 0]), np.array([0, 2]))
        rest = language_model.class_scores(model.tables, vectors, place, np.array([0, 0]), np.array([0, 2]))
        total += 10 ** (scores[0] - rest[0])
    x = model.tables["start"][None, None].repeat(language_model.CONTEXT, 1)
    z, _ = language_model.forward(model.tables, x, np.zeros((1, language_model.CONTEXT), np.float32))
    assert np.exp(z[0, 0]).sum() == pytest.approx(1, abs=1e-4)
    first = z[0, 0] - z[0, 0, 0]
    assert total == pytest.approx(np.exp(first[: language_model.CLASSES]).sum(), rel=1e-3)


def test_windows_score_every_token_once(short_training):
    model = language_model.learn(["a b c a b", "b c d"], language_model.TOKENIZER)
    flat = {name: np.zeros_like(value) for name, value in model.tables.items()}
    n = language_model.CLASSES + 1
    for length in (0, 1, 31, 32, 33, 55, 56, 57, 500):
        score = language_model.class_scores(flat, model.embed[:1], np.zeros(length, np.int64), np.zeros(max(length, 1), np.int64)[:length], np.array([0, length]))
        assert score[0] == pytest.approx(-(length + 1) * math.log10(n), rel=1e-5)


def test_language_model_odd_tables(documents, short_training):
    assert language_model.score_texts(documents()).count() == 0
    rows = language_model.score_texts(documents((1, "a b"), (1, "a b"))).collect()
    assert len(rows) == 2 and rows[0] == rows[1]
