"""The toxicity model against the same sums over strings, one word at a time."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from eventlake.llm import tokens, toxicity

START = "<start>"


def discounted(n, deviations=2):
    return n - min(n, deviations * math.sqrt(n))


class Plain:
    """Class 0 is toxic, 1 ordinary."""

    def __init__(self, texts, labels):
        classes = [0 if y else 1 for y in labels]
        holding = defaultdict(lambda: [0, 0])
        for words, c in zip(texts, classes, strict=True):
            for w in set(words):
                holding[w][c] += 1
        self.total = [sum(n[c] for n in holding.values()) for c in (0, 1)]
        count = {("word", w): n for w, n in holding.items()}
        for w, n in holding.items():
            for length in range(2, min(12, len(w) - 1) + 1):
                stem = count.setdefault(("stem", w[:length]), [0, 0])
                stem[0] += n[0]
                stem[1] += n[1]
        self.count = {node: n for node, n in count.items() if sum(n) >= 2}
        self.dealt = defaultdict(lambda: [0.0, 0.0])
        for (kind, x), n in self.count.items():
            for c in (0, 1):
                self.dealt[self.up(kind, x)][c] += discounted(n[c]) / max(self.total[c], 1)
        pairs, ahead = [defaultdict(set), defaultdict(set)], set()
        for words, c in zip(texts, classes, strict=True):
            for i, w in enumerate(words):
                before = words[i - 1] if i else START
                pairs[c][before, w].add((words[i - 2] if i > 1 else START) if i else START)
                ahead.add((before, w))
        self.pairs = [{pair: len(found) for pair, found in own.items()} for own in pairs]
        self.behind = [Counter(), Counter()]
        self.freed = [Counter(), Counter()]
        for c in (0, 1):
            for (before, _), n in self.pairs[c].items():
                self.behind[c][before] += n
                self.freed[c][before] += min(n, 3 * math.sqrt(n))

    def up(self, kind, x):
        length = len(x) - 1 if kind == "stem" else min(12, len(x) - 1)
        return ("stem", x[:length]) if length >= 2 else None

    def low(self, node, c):
        if node is None:
            return 1.0
        up = self.up(*node)
        both = sum(self.count[up]) if up else sum(self.total)
        share = (sum(self.count[node]) + 0.5) / (both + 1)
        return discounted(self.count[node][c]) / max(self.total[c], 1) + max(self.low(up, c) - self.dealt[up][c], 1e-12) * share

    def left(self, w, c):
        node = next((("stem", w[:n]) for n in range(min(12, len(w) - 1), 1, -1) if ("stem", w[:n]) in self.count), None)
        both = sum(self.count[node]) if node else sum(self.total)
        return max(self.low(node, c) - self.dealt[node][c], 1e-12) * 0.5 / (both + 1)

    def ratio(self, before, w):
        p = []
        for c in (0, 1):
            low = self.low(("word", w), c) if ("word", w) in self.count else self.left(w, c)
            known = ("word", before) in self.count and self.behind[c][before]
            n = self.pairs[c].get((before, w), 0)
            # A pair counts where one of the classes keeps something of it.
            kept = n - min(n, 3 * math.sqrt(n))
            p.append((kept / self.behind[c][before] if known else 0) + (self.freed[c][before] / self.behind[c][before] if known else 1) * low)
        return max(-1, min(1, math.log10(p[0]) - math.log10(p[1])))

    def features(self, words):
        if not words:
            return [0.0] * 5
        ratios = [self.ratio(words[i - 1] if i else START, w) for i, w in enumerate(words)]
        best = {}
        for w, r in zip(words, ratios, strict=True):
            best[w] = max(r, best.get(w, -9))
        top = sorted(best.values(), reverse=True)
        return [sum(ratios) / len(ratios), *[sum(top[:n]) / n for n in (1, 3, 6)], math.log10(len(best))]


@pytest.mark.parametrize("seed", [1, 2])
def test_features_are_the_plain_sums(seed):
    rng = random.Random(seed)
    common = [f"{a}{b}" for a in ("bana", "corti", "du") for b in ("", "x", "yon", "zelement", "zelementari")]
    texts, labels = [], []
    for i in range(150):
        words = rng.choices(common, k=rng.randrange(0, 40))
        if i % 4 == 0:
            words[2:2] = [f"foulmouth{rng.choice('abcdefgh')}{rng.randrange(9)}" for _ in range(3)] + ["plain", "insult"]
        texts.append(words)
        labels.append(int(i % 4 == 0))
    joined = [" ".join(words) for words in texts]
    pieces = lambda rows: tokens.pieces(pa.array(rows, pa.string()), tokens.MARKS, lower=True)
    lessons = toxicity.lessons_of(pieces(joined))
    model = toxicity.tables(lessons.texts, np.array(labels) > 0, lessons)
    plain = Plain(texts, labels)
    asked = [*texts[:40], ["foulmouthz9", "bana", "neverseen", "foulmouthz9"], [], ["q"], ["insult"] * 30]
    got = np.concatenate([model.features(piece) for piece in pieces([" ".join(words) for words in asked])])
    assert got == pytest.approx(np.array([plain.features(words) for words in asked]), abs=1e-9)
    stem, new = plain.ratio("bana", "foulmouthz9"), plain.ratio("bana", "neverseen")
    assert stem > 0.5 > abs(new)
