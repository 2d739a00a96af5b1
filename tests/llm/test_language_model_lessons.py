"""What the language model learns from: all training texts, beyond the texts that it starts from."""

import random
import zlib

import numpy as np

from eventlake.llm import language_model

TRAINING = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]


def score_of(documents, rows, doc_id):
    return {row.doc_id: row.score for row in language_model.score_texts(documents(*rows)).collect()}[doc_id]


def test_texts_beyond_the_sample_teach(documents, monkeypatch):
    """The texts that the model starts from are the same in both tables, and so are all word counts; only the order of words in long texts differs."""
    monkeypatch.setattr(language_model, "ROUNDS", 30)
    monkeypatch.setattr(language_model, "SAMPLE_CHARS", 100)
    monkeypatch.setattr(language_model, "BATCH", 2)
    rng = random.Random(3)
    start = [(i, " ".join(rng.choice(["north", "river", "seven"]) for _ in range(8))) for i in TRAINING[:20]]
    ordered = "apple bridge candle " * 100
    words = ordered.split()
    mixed = []
    for _ in TRAINING[20:60]:
        rng.shuffle(words)
        mixed.append(" ".join(words))
    held = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1)
    judged = (held, ordered[:180])
    learned = score_of(documents, [*start, *[(i, ordered) for i in TRAINING[20:60]], judged], held)
    unlearned = score_of(documents, [*start, *zip(TRAINING[20:60], mixed, strict=True), judged], held)
    assert learned > unlearned + 0.1


def test_windows_hold_every_word_and_goal_once():
    first = np.array([0, 0, 5, 36, 68, 168])
    place, goal = np.arange(168), np.arange(168) % language_model.CLASSES
    words, goals = language_model.windows_of(place, goal, first)
    assert sorted(words[words >= 0]) == list(place) and (words == -1).sum() == 5
    assert sorted(goals[goals >= 0]) == sorted([*goal, *[language_model.CLASSES] * 5])
    assert ((words == -2) == (goals == -1)).all()
