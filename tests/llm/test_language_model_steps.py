"""The language model's numpy steps: same results as the plain formulas, in bounded room."""

from __future__ import annotations

import tracemalloc

import numpy as np
from eventlake.llm import language_model as lm


def peak_of(step) -> int:
    tracemalloc.start()
    try:
        step()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_classes_are_the_nearest_centres_in_bounded_room():
    rng = np.random.default_rng(1)
    vectors, centers = (np.round(rng.normal(size=(n, lm.WIDTH)) * 4096) / 4096 for n in (500, lm.CLASSES))
    model = lm.Model("", vectors, centers, vectors.astype(np.float32), 500)
    lengths = rng.integers(1, 5, 30_000)
    flat, starts = rng.integers(0, 500, lengths.sum()), np.cumsum(lengths) - lengths
    got = []
    peak = peak_of(lambda: got.append(model.classes_of(flat, starts, lengths)))
    means = np.add.reduceat(vectors[flat], starts) / lengths[:, None]
    distance = ((means[:2000, None] - centers[None]) ** 2).sum(axis=2)
    assert (got[0][:2000] == distance.argmin(axis=1)).all()
    assert peak < 10e6  # 30,000 words by 62 classes are 15 MB


def some_windows(rng):
    tables = lm.start_tables(rng)
    tables["out"][:] = rng.normal(0, 0.3, tables["out"].shape)
    inputs = rng.normal(size=(52, lm.WIDTH)).astype(np.float32)
    first = np.array([0, 0, 20, 100, 160])
    words, goals = lm.windows_of(rng.integers(0, 50, 160), rng.integers(0, lm.CLASSES, 50), first)
    return tables, inputs, words, goals


def test_gradients_are_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    tables, inputs, words, goals = some_windows(rng)

    def loss(tables):
        inputs[-1] = tables["start"]
        z, _ = lm.forward(tables, inputs[words], np.zeros(words.shape, np.float32))
        at = goals >= 0
        return -z[at][np.arange(at.sum()), goals[at]].astype(np.float64).mean()

    grads = lm.window_gradients(tables, inputs, words, goals, lm.Room())
    for name in lm.TABLES:
        way = grads[name] / np.sqrt((grads[name] ** 2).sum())
        up, down = ({**tables, name: (tables[name] + sign * 0.01 * way).astype(np.float32)} for sign in (1, -1))
        slope = (loss(up) - loss(down)) / 0.02
        assert abs(slope - np.sqrt((grads[name] ** 2).sum())) < 0.02 * abs(slope) + 1e-4, name


def test_steps_use_their_room_again():
    rng = np.random.default_rng(3)
    tables, inputs, words, goals = some_windows(rng)
    words, goals, room = np.tile(words, (8, 1)), np.tile(goals, (8, 1)), lm.Room()
    once = {name: grad.copy() for name, grad in lm.window_gradients(tables, inputs, words, goals, room).items()}
    again = []
    peak = peak_of(lambda: again.append(lm.window_gradients(tables, inputs, words, goals, room)))
    assert all(np.array_equal(once[name], again[0][name]) for name in lm.TABLES)
    assert peak < 4 * words.size * (lm.CLASSES + 1)  # less than one array of the classes at all positions


def test_places_of_hashes():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for some in (keys, keys >> np.uint64(40)):  # evenly spread, and all in one range
            some = np.unique(some)
            drawn = rng.integers(0, len(some), 300)
            assert (lm.places_in(some)(some[drawn]) == drawn).all()
    assert not len(lm.places_in(np.zeros(0, np.uint64))(np.zeros(0, np.uint64)))
