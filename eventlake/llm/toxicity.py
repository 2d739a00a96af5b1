"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, toxic and ordinary, are fitted on a bounded sample of labelled texts. Both
interpolate with discounted counts (the discount grows with the count's own error). A bigram backs off to its word, a word to its
stem, and a stem to shorter ones: at every step a class keeps the discounted count of documents that hold the word or
stem, and deals out what the discounts left by the counts of both classes together. So a rare or unseen expression is
told by its stem, if that stem is toxic, and is smoothed alike in both classes where nothing is known, so it does not tip the
balance by being rare. A text is compared by its length-normalised log-likelihood ratio, and by the mean ratio of its
highest 1, 3 and 6 distinct words, so that insults in a long text are not diluted; as highest values rise with the
number of words, that number goes in, too. A logistic curve fitted on the labelled
texts, each scored by models that have not seen it, turns these into the score.

The model is a few sorted arrays whose size is bounded by the sample (``MOST_TEXTS`` texts, whole ones of any length), fitted in one
task; it travels with the tasks, and scoring is one pass without a shuffle and needs no id, language or source.

Cases: a text without words (null, empty) scores as the class prior does. Rows without a label, or
with another one than 0 and 1, do not teach; conflicting labels of one document each count. With no
usable label, or only one class, the score is the share of toxic labels (0.5 without any). Every row gives one row,
repeated rows alike; an empty table gives none; further columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm import tokens
from eventlake.llm.learning import fitted, in_fold, sampled, scored
from eventlake.session import discard, pinned

MOST_TEXTS = 8000
STEM_BYTES = range(2, 13)  # lengths of the stems that a word backs off to
LEAST_TEXTS = 2  # documents that a word or stem needs to be kept
TOPS = (1, 3, 6)
FOLDS = 4
SHARE = 1 << 18  # words whose pairs are counted at a time
REJECT = 0.3
MOST_SAID = 1.0  # no word shifts the balance by more than a factor of ten
NOTHING = 1e-12
START = np.uint64(0x5BD1E995)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in the sorted keys; their number where it is missing."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


def discounts(n: np.ndarray, deviations: float = 2) -> np.ndarray:
    """What a count gives to its back-off: some standard deviations of it, all of a small count."""
    return np.minimum(n, deviations * np.sqrt(n))


def bigrams(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    return tokens.mixed(before * np.uint64(tokens.STEP) + words)


def befores(values: np.ndarray, firsts: np.ndarray, start) -> np.ndarray:
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[firsts] = start
    return out


def stems_of(piece: tokens.Piece, places: np.ndarray) -> np.ndarray:
    """(words, stems): hashes of the proper beginnings of words, 0 where a word is not longer."""
    first, length = piece.starts[places], (piece.ends - piece.starts)[places]
    hashed, out = np.zeros(len(places), np.uint64), np.zeros((len(places), len(STEM_BYTES)), np.uint64)
    for i in range(STEM_BYTES[-1]):
        byte = tokens.VALUES[True][piece.data[np.minimum(first + i, len(piece.data) - 1)]]
        hashed = tokens.mixed(hashed * np.uint64(tokens.STEP) + byte)
        if i + 1 in STEM_BYTES:
            out[:, i + 1 - STEM_BYTES[0]] = np.where(length > i + 1, hashed, 0)
    return out


@dataclass
class Model:
    """Tables of both classes (toxic in column 0, ordinary in column 1); row -1 of ``node`` tables is for what has no known stem."""

    nodes: np.ndarray  # words and stems
    low: np.ndarray  # probability of a node
    left: np.ndarray  # what its known longer words leave to unknown ones
    total: np.ndarray  # bigrams that begin with the word
    open: np.ndarray  # share of the probability behind a word that its bigrams leave to the lower order
    pairs: np.ndarray
    count: np.ndarray  # discounted counts of bigrams
    curve: np.ndarray  # weights of the features and the constant

    def features(self, piece: tokens.Piece) -> np.ndarray:
        """(texts, 2 + tops): mean ratio, mean of the highest ones of distinct words, size of the text; 0 without words."""
        out = np.zeros((len(piece.rows), 2 + len(TOPS)))
        words, counts = piece.hashes, piece.counts()
        if not len(words):
            return out
        filled = np.flatnonzero(counts)
        starts = piece.first[:-1][filled]
        distinct, first, number = np.unique(words, return_index=True, return_inverse=True)
        known = lookup(self.nodes, distinct)
        at = np.where(known < len(self.nodes), known, -1)
        p = self.low[at]
        strange = np.flatnonzero(at < 0)
        if len(strange):
            stem = np.full(len(strange), -1)
            for column in stems_of(piece, first[strange]).T:  # the longest known one stays
                found = lookup(self.nodes, column)
                stem = np.where((column > 0) & (found < len(self.nodes)), found, stem)
            p[strange] = self.left[stem]
        at, p = at[number], p[number]
        behind = befores(at, starts, -1)
        pair = lookup(self.pairs, bigrams(words, befores(words, starts, START)))
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = np.where(self.total[behind] > 0, self.count[pair] / self.total[behind], 0.0)
        p = seen + self.open[behind] * p
        ratio = np.clip(np.log10(p[:, 0]) - np.log10(p[:, 1]), -MOST_SAID, MOST_SAID)
        out[filled, 0] = np.add.reduceat(ratio, starts) / counts[filled]
        row = piece.document_of_word()
        order = np.lexsort((-ratio, number, row))
        once = order[np.concatenate([[True], (row[order[1:]] != row[order[:-1]]) | (number[order[1:]] != number[order[:-1]])])]
        once = once[np.lexsort((-ratio[once], row[once]))]
        size = np.bincount(row[once], minlength=len(piece.rows))
        begin = np.cumsum(size) - size
        upto = np.concatenate([[0.0], np.cumsum(ratio[once])])
        for column, top in enumerate(TOPS):
            out[:, 1 + column] = (upto[begin + np.minimum(size, top)] - upto[begin]) / top
        out[:, -1] = np.log10(np.maximum(size, 1))
        return out

    def __call__(self, piece: tokens.Piece) -> np.ndarray:
        if not len(self.nodes):
            return np.full(len(piece.rows), self.curve[-1])
        return logistic(self.features(piece), self.curve)


@dataclass
class Lessons:
    """The labelled texts as numbers of words, and the distinct words with their stems."""

    texts: list[np.ndarray]
    known: np.ndarray
    stems: np.ndarray


def lessons_of(pieces: Iterator[tokens.Piece]) -> Lessons:
    texts, known, numbers = [], np.zeros(0, np.uint64), np.zeros(0, np.int32)
    stems = [np.zeros((0, len(STEM_BYTES)), np.uint64)]
    for piece in pieces:
        # Words are numbered as they come, so that a piece adds its new ones only.
        distinct, first, number = np.unique(piece.hashes, return_index=True, return_inverse=True)
        at = lookup(known, distinct)
        new = np.flatnonzero(at == len(known))
        number_of = np.append(numbers, 0)[at]
        number_of[new] = len(known) + np.arange(len(new))
        if len(new):
            stems.append(stems_of(piece, first[new]))
            known, numbers = np.concatenate([known, distinct[new]]), np.concatenate([numbers, number_of[new]])
            order = np.argsort(known, kind="stable")
            known, numbers = known[order], numbers[order]
        own = number_of[number].astype(np.int32)
        texts += [own[a:b] for a, b in zip(piece.first[:-1], piece.first[1:], strict=True)]
    place = np.empty(len(known), np.int32)  # of a word in the order of hashes
    place[numbers] = np.arange(len(known), dtype=np.int32)
    return Lessons([place[own] for own in texts], known, np.concatenate(stems)[numbers])


def node_tables(texts: list[np.ndarray], toxic: np.ndarray, lessons: Lessons) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, their probabilities, and what they leave to unknown words below them."""
    holding = np.zeros((len(lessons.known), 2))  # documents that hold the word
    for words, kind in zip(texts, toxic, strict=True):
        holding[np.unique(words), 0 if kind else 1] += 1
    depth = (lessons.stems > 0).sum(axis=1)
    longest = np.where(depth > 0, lessons.stems[np.arange(len(depth)), np.maximum(depth - 1, 0)], 0)
    enough = np.flatnonzero(holding.sum(axis=1) >= LEAST_TEXTS)
    parts = [(lessons.known[enough], holding[enough], longest[enough], np.full(len(enough), len(STEM_BYTES)))]
    for level in range(len(STEM_BYTES)):
        own = np.flatnonzero(lessons.stems[:, level])
        stem, first, number = np.unique(lessons.stems[own, level], return_index=True, return_inverse=True)
        below = np.stack([np.bincount(number, weights=holding[own, kind], minlength=len(stem)) for kind in (0, 1)], axis=1)
        above = lessons.stems[own[first], level - 1] if level else np.zeros(len(stem), np.uint64)
        enough = np.flatnonzero(below.sum(axis=1) >= LEAST_TEXTS)
        parts.append((stem[enough], below[enough], above[enough], np.full(len(enough), level)))
    nodes, count, above, level = (np.concatenate(column) for column in zip(*parts, strict=True))
    order = np.argsort(nodes, kind="stable")
    nodes, count, above, level = nodes[order], count[order], above[order], level[order]
    total = holding.sum(axis=0)
    up = np.where(above > 0, lookup(nodes, above), len(nodes))
    own = (count - discounts(count)) / np.maximum(total, 1)
    dealt = np.stack([np.bincount(up, weights=own[:, kind], minlength=len(nodes) + 1) for kind in (0, 1)], axis=1)
    both = np.append(count.sum(axis=1), total.sum())
    share = (both[:-1] + 0.5) / (both[up] + 1)
    low = np.ones((len(nodes) + 1, 2))
    for step in range(len(STEM_BYTES) + 1):
        at = np.flatnonzero(level == step)
        low[at] = own[at] + np.maximum(low[up[at]] - dealt[up[at]], NOTHING) * share[at][:, None]
    return nodes, low, np.maximum(low - dealt, NOTHING) * (0.5 / (both + 1))[:, None]


def tables(texts: list[np.ndarray], toxic: np.ndarray, lessons: Lessons) -> Model:
    """Both class models over one vocabulary."""
    nodes, low, left = node_tables(texts, toxic, lessons)
    node_of = np.append(lookup(nodes, lessons.known), len(nodes))
    sizes = np.array([len(words) for words in texts])
    flat = np.concatenate([*texts, np.zeros(0, np.int32)])
    firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
    none = len(lessons.known)
    before = befores(flat, firsts, none)
    opening = np.zeros(len(flat), dtype=bool)
    opening[firsts] = True
    kind = np.repeat(np.where(toxic, 0, 1).astype(np.int8), sizes)
    total, given = np.zeros((len(nodes) + 1, 2)), np.zeros((len(nodes) + 1, 2))
    keys, kept = [np.zeros(0, np.uint64)], [np.zeros((0, 2))]
    hashes = np.append(lessons.known, START)
    for own in shares_of(before, none + 1):  # all pairs of a first word lie in one share
        pairs, first, pair = np.unique(before[own].astype(np.int64) * (none + 1) + flat[own], return_index=True, return_inverse=True)
        behind = node_of[before[own]]
        # A pair counts once per word before it: a passage that was copied counts like one.
        ahead = np.where(opening[own], none, before[own - 1]).astype(np.int64) * len(pairs) + pair
        count = np.zeros((len(pairs), 2))
        for c in (0, 1):
            of_kind = np.flatnonzero(kind[own] == c)
            of_kind = of_kind[np.unique(ahead[of_kind], return_index=True)[1]]
            count[:, c] = np.bincount(pair[of_kind], minlength=len(pairs))
            total[:, c] += np.bincount(behind[of_kind], minlength=len(nodes) + 1)
            given[:, c] += np.bincount(behind[first], weights=discounts(count[:, c], 3), minlength=len(nodes) + 1)
        left_over = count - discounts(count, 3)
        useful = np.flatnonzero(left_over.max(axis=1) > 0)
        keys.append(bigrams(hashes[pairs[useful] % (none + 1)], hashes[pairs[useful] // (none + 1)]))
        kept.append(left_over[useful])
    total[-1], given[-1] = 0, 0  # words that are no node tell nothing of what follows
    keys, kept = np.concatenate(keys), np.concatenate(kept)
    order = np.argsort(keys)
    opened = np.where(total > 0, given / np.maximum(total, 1), 1.0)
    return Model(nodes, low, left, total, opened, keys[order], np.vstack([kept[order], np.zeros((1, 2))]), np.zeros(3 + len(TOPS)))


def shares_of(numbers: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Places of ranges of the numbers below ``n``, about ``SHARE`` places at a time; equal numbers stay together."""
    upto = np.zeros(n, np.int64)
    for a in range(0, len(numbers), SHARE):
        upto += np.bincount(numbers[a : a + SHARE], minlength=n)
    upto = np.cumsum(upto)
    begin = 0
    while begin < n:
        done = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, done + SHARE, "right")))
        yield np.flatnonzero((numbers >= begin) & (numbers < end))
        begin = end


def logistic(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ curve[:-1] + curve[-1], -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a light ridge."""
    design = np.column_stack([x, np.ones(len(x))])
    curve = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = logistic(x, curve)
        slope = design.T @ (y - p) - 0.01 * curve
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(len(curve))
        step = np.linalg.solve(bend, slope)
        curve = curve + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return curve


def fit(texts: list[str], labels: list[int]) -> Model:
    """Both class models and the curve; out-of-fold features teach the curve."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        none, two = np.zeros(0, np.uint64), np.zeros((1, 2))
        return Model(none, two, two, two, two, none, two, np.array([*[0.0] * (2 + len(TOPS)), y.mean() if len(y) else 0.5]))
    cut = lambda rows: tokens.pieces(pa.array([texts[i] for i in rows], pa.string()), tokens.MARKS, lower=True)
    lessons = lessons_of(cut(range(len(texts))))
    fold = np.arange(len(y)) % FOLDS
    out = np.zeros((len(y), 2 + len(TOPS)))
    for k in range(FOLDS):
        held, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(held) and len(rest):
            part = tables([lessons.texts[i] for i in rest], y[rest] > 0, lessons)
            out[held] = np.concatenate([part.features(piece) for piece in cut(held)])
    model = tables(lessons.texts, y > 0, lessons)
    model.curve = fit_curve(out, y)
    return model


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, most: int = MOST_TEXTS) -> Model:
    """The model of a bounded sample of labelled rows: half toxic and half ordinary, as far as there are."""
    graded = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("grade"))
    sample, shares = sampled(docs, graded.where(may_learn), most)
    sample = pinned(sample)
    model = fitted(sample, fit)
    if len(model.nodes):
        drawn = sample.agg(F.avg("grade")).first()[0]
        # The sample may hold more toxic rows than the labels do: the constant goes back to their share.
        model.curve[-1] += np.log(shares[1] / shares[0]) - np.log(drawn / (1 - drawn))
    elif shares:
        model.curve[-1] = shares.get(1, 0.0)
    discard(sample)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` columns in ``keep`` and the score of every row."""
    return scored(docs, list(keep), text, [out], tokens.MARKS, True, model)


def held_out(doc_id: Column) -> Column:
    return in_fold(doc_id, 4, 2)


def judge(docs: DataFrame, labels: DataFrame, reject: float = REJECT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; rows of the held-out fold do not teach."""
    model = learn(docs, labels, ~held_out(F.col("doc_id")))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= reject).cast("int").alias("predicted"))
