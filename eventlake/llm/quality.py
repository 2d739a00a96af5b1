"""Quality grades by ordinal cumulative-link regression on hashed text.

Grades are ordered. One weight per hashed feature is shared by all grades, and ordered thresholds
cut the line: ``P(grade > j) = logistic(weights . features - threshold_j)``. Thresholds are kept in order by
construction (a first one and positive gaps). Features are the words of a text, the kinds of characters each word
holds together, and whether a word repeats the one before, each as the square root of its share of the words,
so a text counts the same however long it is. The fit is full-batch gradient descent with momentum over a bounded
sample of labelled texts; the model is one array of ``BUCKETS`` weights, and scoring is one pass without a shuffle.

Results are the expected grade and the tail probability of a chosen grade, by which texts are selected.

Cases: a text without words (null, empty) has no feature and gets the grade shares of the thresholds alone. Rows without a
grade do not teach. Without labels, or with one grade only, every text gets that grade. Every row gives one row, repeated
rows alike; an empty table gives none; further columns are not carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm import tokens
from eventlake.llm.learning import fitted, in_fold, sampled, scored

BUCKETS = 1 << 16
MOST_TEXTS = 8000
LEAST_GAP = 0.5
ROUNDS = 300
RIDGE = 1e-5
KEEP_FROM = 0.5

# Kinds of characters, one bit each: digit, upper case, lower case, beyond ASCII, and the marks that junk is made of.
KINDS = np.zeros(256, dtype=np.uint16)
KINDS[0x21:0x30] = 1 << 4
KINDS[0x3A:0x7F] = 1 << 4
KINDS[0x30:0x3A], KINDS[0x41:0x5B], KINDS[0x61:0x7B], KINDS[0x80:] = 1, 2, 4, 8
for bit, mark in enumerate("!#$%&*|"):
    KINDS[ord(mark)] = 1 << (5 + bit)


def features(piece: tokens.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values of the features of a piece, sorted by row."""
    n = piece.counts()
    if not len(piece.hashes):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    row = piece.document_of_word()
    kinds = np.bitwise_or.reduceat(KINDS[piece.data], piece.starts).astype(np.uint64)
    again = np.zeros(len(row), dtype=np.uint64)
    again[1:] = (piece.hashes[1:] == piece.hashes[:-1]) & (row[1:] == row[:-1])
    shapes = tokens.mixed(kinds * np.uint64(2) + again + np.uint64(1 << 32))
    rows, values = np.concatenate([row, row]), np.concatenate([piece.hashes, shapes])
    cell, count = np.unique(rows * BUCKETS + (values % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    return cell // BUCKETS, cell % BUCKETS, np.sqrt(count / n[cell // BUCKETS])


@dataclass
class Model:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, piece: tokens.Piece) -> np.ndarray:
        """(texts, grades - 1): probability of more than each grade but the last."""
        row, bucket, value = features(piece)
        line = np.bincount(row, weights=value * self.weights[bucket], minlength=len(piece.rows)) if len(row) else np.zeros(len(piece.rows))
        return 1 / (1 + np.exp(-np.clip(line[:, None] - self.thresholds, -30, 30)))

    def __call__(self, piece: tokens.Piece) -> np.ndarray:
        """Expected grade, then the tail probability of every grade but the first."""
        above = self.above(piece)
        return np.column_stack([self.grades[0] + above @ np.diff(self.grades), above])


def fit(texts: list[str], grades: list[int]) -> Model:
    known = np.unique(grades).astype(float) if grades else np.zeros(1)
    if len(known) < 2:
        return Model(known, np.zeros(BUCKETS), np.zeros(0))
    parts, offset = [], 0
    for piece in tokens.pieces(pa.array(texts, pa.string()), tokens.WHITE, lower=True):
        row, bucket, value = features(piece)
        parts.append((row + offset, bucket, value))
        offset += len(piece.rows)
    row, bucket, value = (np.concatenate(x) for x in zip(*parts, strict=True))
    y = np.searchsorted(known, grades)
    n, cuts = len(y), len(known) - 1
    # Every grade weighs alike; the thresholds return to the shares afterwards.
    weight = (n / len(known) / np.bincount(y, minlength=len(known)))[y]
    weights, first, gaps = np.zeros(BUCKETS), 0.0, np.zeros(cuts - 1)
    momentum = [np.zeros(BUCKETS), 0.0, np.zeros(cuts - 1)]
    edge = np.concatenate([np.full((n, 1), -np.inf), np.zeros((n, cuts)), np.full((n, 1), np.inf)], axis=1)
    at = np.arange(n)
    for _ in range(ROUNDS):
        thresholds = first + np.concatenate([[0.0], np.cumsum(LEAST_GAP + np.exp(gaps))])
        line = np.bincount(row, weights=value * weights[bucket], minlength=n)
        edge[:, 1:-1] = thresholds - line[:, None]
        below = 1 / (1 + np.exp(-np.clip(edge, -30, 30)))
        below[:, 0], below[:, -1] = 0, 1
        slope = below * (1 - below)
        p = np.maximum(below[at, y + 1] - below[at, y], 1e-9)
        # Gradient of the mean log-likelihood with respect to the line and to each threshold.
        to_line = weight * (slope[at, y] - slope[at, y + 1]) / p / n
        to_cut = np.zeros((n, cuts + 2))
        to_cut[at, y + 1] += weight * slope[at, y + 1] / p / n
        to_cut[at, y] -= weight * slope[at, y] / p / n
        cut = to_cut[:, 1:-1].sum(axis=0)
        steps = [
            np.bincount(bucket, weights=value * to_line[row], minlength=BUCKETS) - RIDGE * weights,
            cut.sum(),
            np.array([cut[j + 1 :].sum() * np.exp(gaps[j]) for j in range(cuts - 1)]),
        ]
        momentum = [0.9 * m + s for m, s in zip(momentum, steps, strict=True)]
        weights, first, gaps = weights + 5 * momentum[0], first + momentum[1], gaps + 0.1 * np.clip(momentum[2], -1, 1)
    return Model(known, weights, first + np.concatenate([[0.0], np.cumsum(LEAST_GAP + np.exp(gaps))]))


def grade_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 good but toxic, 2 good; other labels give none."""
    good, toxic = F.col("quality"), F.col("toxic")
    return labels.select("doc_id", F.when(good == 0, 0).when((good == 1) & (toxic == 1), 1).when((good == 1) & (toxic == 0), 2).alias("grade"))


def learn(docs: DataFrame, graded: DataFrame, most: int = MOST_TEXTS) -> Model:
    return fitted(sampled(docs, graded, most)[0], fit)


def grade_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, expected_grade, and tail_1, tail_2, ... (probability of reaching the next grades)."""
    names = ["expected_grade", *[f"tail_{i + 1}" for i in range(len(model.grades) - 1)]]
    return scored(docs, list(keep), text, names, tokens.WHITE, True, model)


def held_out(doc_id: Column) -> Column:
    return in_fold(doc_id, 4, 2)


def select(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, keep): kept when the first grade above the least is likely."""
    model = learn(docs, grade_of(labels).where(~held_out(F.col("doc_id"))))
    graded = grade_texts(docs, model)
    tail = F.col("tail_1") if "tail_1" in graded.columns else F.lit(float(model.grades[0] > 0))
    return graded.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", tail.alias("tail_probability"), (tail >= keep_from).alias("keep")
    )
