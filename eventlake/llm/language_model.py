"""LM scoring: a small causal self-attention model over subword ids, trained in numpy.

A public subword tokenizer (``TOKENIZER``; its path is a parameter and must exist on every executor) turns each word into
subword ids; a text is its words and one end mark. A position of the model is a word: the mean of the embeddings of its subword ids.
One head of causal self-attention looks back over a window of ``CONTEXT`` positions and gives, for the next word, the probabilities of
``CLASSES`` word classes and of the end. A word is then drawn within its class by its count in the training corpus; a share of each
class, that of the words the corpus holds once, is left to unseen words, which are spelled by subword ids as words of their class
are. No part sums to more than one, so the score is a proper log-probability of the text.

* Everything learned comes from all training documents, whole, by four passes; a bounded sample of texts (``SAMPLE``, of at most
  ``SAMPLE_CHARS`` characters) only gives the directions and weights that the passes start from.

  1. Batches count their words where they lie, by block (a range of ids), and add up the company of subwords: one step of subspace
     iteration on the weighted (document, subword) table. A shuffle adds the blocks up; each block gets back the counts of its own words
     only, never the whole vocabulary. Input that is not in the order of ids has more rows to add up, as a batch then holds parts of many blocks.
  2. The leading directions of company are the vectors of the subwords, and so the input embeddings; classes are clusters of all subwords
     by their vectors, so any word has its class from its spelling. Tokens by class and the spelling of unseen words are added up over
     all distinct training words.
  3. Attention weights: each block takes gradient steps on all windows of all its training texts, from common weights; the mean over
     the blocks, by their windows, is the model. Texts of a block are put in order, so reruns agree, however the input is cut.
  4. Scoring.
* Windows overlap: each is ``CONTEXT`` positions long, and all but the first score only their last ``STRIDE`` positions, so every token is
  scored once, with at least ``CONTEXT - STRIDE`` positions before it (as many as there are at the start of a text). Windows of many
  texts are scored together by batched masked matrix products.

``base_score`` is the smoothed unigram log-probability of the same tokens from the same counts, by word, for comparison.

Cases: null and empty texts are the end mark alone. Held-out rows (and rows without id, which are in no fold and so teach) are scored like the
others. Without training documents all words are unseen. Rows of one id and text are counted each, and every input row gives one row; an empty table gives none;
further columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm import tokens
from eventlake.llm.learning import in_fold
from eventlake.llm.shipping import ship
from eventlake.session import pinned

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
CONTEXT, STRIDE = 32, 24
WIDTH = 24
CLASSES = 62
SAMPLE, SAMPLE_CHARS = 2000, 5000
ROUNDS, BATCH = 500, 64
BLOCK_IDS = 2048
NULL_BLOCKS = 1 << 20  # rows without an id are dealt by their texts
END = np.uint64(0xE17D0E17D0E17D0E)
CACHED_WORDS = 1_000_000
SOME_WORDS, SOME_WINDOWS = 4096, 128  # worked on at a time


class Subwords:
    """Subword ids of words by a public sentence-piece vocabulary."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.known = SentencePieceProcessor(model_file=path)
        self.size = self.known.vocab_size()

    def ids(self, words: list[bytes]) -> list[list[int]]:
        return [x or [0] for x in self.known.encode([w.decode() for w in words], num_threads=1)]


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in a row, where each word starts, and how many each has."""
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(lengths.sum()))
    return flat, np.cumsum(lengths) - lengths, lengths


@dataclass
class Model:
    path: str
    subword: np.ndarray  # subword id -> vector for classes
    centers: np.ndarray  # class centres
    embed: np.ndarray  # subword id -> row of the input embeddings
    size: int = 0  # of the subword vocabulary
    tables: dict = field(default_factory=dict)
    spelling: np.ndarray | None = None  # log10 probability of a subword by class and by whether it is the first of its word
    stop: float = 0.0  # log10 probability that a word ends after a subword, and that it goes on
    go: float = 0.0

    def classes_of(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Classes of words, given as subword ids in a row. Vectors and centres are multiples of 2^-12, so this is exact: a word has one class in every pass."""
        out = np.empty(len(starts), np.int64)
        weights = np.concatenate([-2 * self.centers.T, (self.centers**2).sum(axis=1)[None]])
        for a in range(0, len(out), SOME_WORDS):
            own = slice(a, a + SOME_WORDS)
            sums = word_sums(self.subword, flat, starts[own], lengths[own])
            out[own] = np.argmin(np.column_stack([sums, lengths[own]]) @ weights, axis=1)
        return out

    def vectors_of(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Input vectors of words."""
        return word_sums(self.embed, flat, starts, lengths) / lengths[:, None].astype(np.float32)

    def spelled_of(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Spelling log-probabilities of words."""
        cost = self.spelling[np.repeat(classes, lengths), later(flat, starts), flat] + self.go
        cost[starts + lengths - 1] += self.stop - self.go
        return np.add.reduceat(cost, starts)


def word_sums(values: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over the subwords of each word, the n-th ones of all words at a time."""
    out = np.empty((len(lengths), values.shape[1]), values.dtype)
    order = np.argsort(-lengths, kind="stable")
    first, sums = starts[order], values[flat[starts[order]]]
    longer = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=1)), "left")  # words of more than n subwords
    for n, upto in enumerate(longer, 1):
        sums[:upto] += values[flat[first[:upto] + n]]
    out[order] = sums
    return out


def later(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """0 for the first subword of each word, 1 for the others."""
    out = np.ones(len(flat), dtype=np.int64)
    out[starts] = 0
    return out


# --- learning -------------------------------------------------------------------------------------------------------


def sample_words(texts: list[str], subwords: Subwords) -> tuple[list[list[int]], list[list[int]]]:
    """Texts as numbers of distinct words, and the subword ids of those words."""
    docs = []
    for piece in tokens.pieces(pa.array(texts, pa.string()), lower=True):
        docs += [[piece.word(i).lower() for i in range(a, b)] for a, b in zip(piece.first[:-1], piece.first[1:], strict=True)]
    vocabulary = sorted({w for doc in docs for w in doc})
    number = {w: i for i, w in enumerate(vocabulary)}
    return [[number[w] for w in doc] for doc in docs], subwords.ids(vocabulary) if vocabulary else []


def learn(texts: list[str], path: str, seed: int = 1) -> Model:
    """The model of a few texts, all in memory."""
    rng = np.random.default_rng(seed)
    subwords = Subwords(path)
    docs, ids = sample_words(texts, subwords)
    company = Company(start_basis(docs, ids, subwords.size, rng))
    for doc in docs:
        flat, _, lengths = flattened([ids[w] for w in doc])
        company.add(np.zeros(int(lengths.sum()), np.int64), flat, 1)
    model = model_of(path, company, rng)
    if ids:
        flat, starts, lengths = flattened(ids)
        cells, n = np.unique(spelling_cells(model, flat, starts, lengths), return_counts=True)
        spelled_model(model, cells, n, len(ids), len(flat))
    else:
        spelled_model(model, np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0)
    return train_start(model, docs, ids, rng)


def start_basis(docs, ids, size: int, rng) -> np.ndarray:
    """Leading directions of the weighted table of the sample's texts and their subwords."""
    used = np.unique([s for x in ids for s in x]) if ids else np.zeros(0, np.int64)
    out = np.zeros((size, WIDTH))
    if not len(used):
        return out
    column = np.full(size, -1)
    column[used] = np.arange(len(used))
    rows = np.zeros((len(docs), len(used)), dtype=np.float32)
    for d, doc in enumerate(docs):
        flat = [s for w in doc for s in ids[w]]
        if flat:
            rows[d] = np.bincount(column[flat], minlength=len(used))
    rows = np.sqrt(rows / np.maximum(rows.sum(axis=1, keepdims=True), 1))
    rows -= rows.mean(axis=0)
    wide = min(WIDTH, *rows.shape)
    basis = rng.normal(size=(len(used), wide)).astype(np.float32)
    for _ in range(8):  # subspace iteration
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    out[used, :wide] = basis
    return out


class Company:
    """Sums over documents for one step of subspace iteration: by subword, what its documents project to, its weight and its squared weight."""

    def __init__(self, basis: np.ndarray):
        self.basis, self.docs = basis, 0
        self.sums = np.zeros((len(basis), basis.shape[1] + 3))  # the last column counts occurrences

    def add(self, doc: np.ndarray, subword: np.ndarray, n_docs: int) -> None:
        """Occurrences of subwords in the documents 0 to ``n_docs`` - 1."""
        size = len(self.basis)
        self.docs += n_docs
        key, n = np.unique(doc * size + subword, return_counts=True)
        if not len(key):
            return
        of_doc, of_subword = np.divmod(key, size)
        weight = np.sqrt(n / np.bincount(of_doc, weights=n)[of_doc])
        begin = np.flatnonzero(np.diff(of_doc, prepend=-1))
        projected = np.add.reduceat(weight[:, None] * self.basis[of_subword], begin, axis=0)
        order = np.argsort(of_subword, kind="stable")
        begin_of = np.flatnonzero(np.diff(of_subword[order], prepend=-1))
        back = np.cumsum(np.diff(of_doc, prepend=of_doc[0]) != 0)
        values = np.column_stack([weight[:, None] * projected[back], weight, weight**2, n])[order]
        self.sums[of_subword[order][begin_of]] += np.add.reduceat(values, begin_of, axis=0)


def model_of(path: str, company: Company, rng) -> Model:
    """Vectors of subwords by the documents they occur in, input embeddings and classes."""
    sums, n = company.sums, max(company.docs, 1)
    size, wide = company.basis.shape
    mean = sums[:, wide] / n
    step = sums[:, :wide] - n * np.outer(mean, mean @ company.basis)  # of the centred table
    directions, triangle = np.linalg.qr(step)
    vectors = directions * np.sqrt(np.abs(np.diag(triangle))) / np.sqrt(np.maximum(sums[:, wide + 1] - n * mean**2, 1e-12))[:, None]
    counts = sums[:, wide + 2]
    vectors[counts == 0] = 0
    vectors = np.round(vectors * 4096) / 4096
    spread = np.sqrt((counts[:, None] * vectors**2).sum(axis=0) / max(counts.sum(), 1))
    embed = 0.5 * vectors / np.maximum(spread, 1e-6) + rng.normal(0, 0.3, vectors.shape)  # subwords of like company stay apart
    seen = counts > 0
    centers = cluster(vectors[seen], counts[seen], CLASSES, rng) if seen.any() else np.zeros((1, wide))
    return Model(path, vectors, np.round(centers * 4096) / 4096, np.clip(embed, -3, 3).astype(np.float32), size)


def cluster(points: np.ndarray, weight: np.ndarray, k: int, rng) -> np.ndarray:
    chosen = rng.choice(len(points), size=min(k, len(points)), replace=False, p=weight / weight.sum() if (weight > 0).sum() >= k else None)
    centers = points[chosen].copy()
    for _ in range(15):
        near = np.argmin((centers**2).sum(axis=1) - 2 * points @ centers.T, axis=1)
        mass = np.bincount(near, weights=np.sqrt(weight), minlength=len(centers))
        for d in range(points.shape[1]):
            total = np.bincount(near, weights=np.sqrt(weight) * points[:, d], minlength=len(centers))
            centers[:, d] = np.where(mass > 0, total / np.maximum(mass, 1e-9), centers[:, d])
    return centers


def spelling_cells(model: Model, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(class, first or later, subword) of every subword of some words, as one number."""
    return (np.repeat(model.classes_of(flat, starts, lengths), lengths) * 2 + later(flat, starts)) * model.size + flat


def spelled_model(model: Model, cells: np.ndarray, n: np.ndarray, words: int, pieces: int) -> Model:
    """Spelling of unseen words: subwords by their counts over the distinct words of a class, backed off to those of all words."""
    counts = np.zeros(len(model.centers) * 2 * model.size, np.float32)
    counts[cells] = n
    counts = counts.reshape(len(model.centers), 2, model.size)
    shared = counts.sum(axis=0) + 0.02
    shared /= shared.sum(axis=1, keepdims=True)
    total = counts.sum(axis=2, keepdims=True) + 30
    counts += 30 * shared
    counts /= total
    model.spelling = np.log10(counts, out=counts)
    stop = min(max(words / max(pieces, 1), 0.05), 0.95)
    model.stop, model.go = np.log10(stop), np.log10(1 - stop)
    return model


def start_tables(rng) -> dict:
    scale = WIDTH**-0.5
    tables = {name: rng.normal(0, scale, (WIDTH, WIDTH)).astype(np.float32) for name in ("query", "key", "value")}
    tables["out"] = np.zeros((2 * WIDTH, CLASSES + 1), np.float32)
    tables["bias"] = np.zeros(CLASSES + 1, np.float32)
    tables["start"] = rng.normal(0, 0.3, WIDTH).astype(np.float32)
    tables["near"] = np.zeros(CONTEXT, np.float32)  # by distance
    return tables


BACK = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]


class Room:
    """Arrays of one loop by name, used again at every step: fresh ones of their size cost as much as what is computed in them."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.kept or self.kept[name].size < size:
            self.kept[name] = np.empty(size, np.float32)
        return self.kept[name][:size].reshape(shape)


def exponentials(x: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(x - shift), its sums by row, and the shift, which is 0 unless rows would leave the range of numbers."""
    ones = np.ones(x.shape[-1], x.dtype)
    with np.errstate(over="ignore"):
        np.exp(x, out=out)
        total = out @ ones
    if np.isfinite(total).all() and total.min(initial=1) > 1e-30:
        return out, total, 0.0
    top = x.max(axis=-1)
    np.exp(x - top[..., None], out=out)
    return out, out @ ones, top


def input_weights(tables: dict) -> np.ndarray:
    """Of query, key and value side by side; queries are scaled."""
    return np.concatenate([tables["query"] * np.float32(WIDTH**-0.5), tables["key"], tables["value"]], axis=1)


def class_values(tables: dict, x: np.ndarray, room: Room, begin: int = 0, mask: np.ndarray | None = None):
    """Logarithms of the weights of the classes, by rows, at the positions from ``begin`` on of windows ``x`` (windows, positions, width).

    A position looks at itself and back, so what fills a window behind its text changes nothing in the text."""
    windows, n, _ = x.shape
    qkv = room("qkv", windows, n, 3 * WIDTH)
    np.matmul(x.reshape(-1, WIDTH), input_weights(tables), out=qkv.reshape(-1, 3 * WIDTH))
    q, k, v = qkv[:, begin:, :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    back = BACK[begin:n, :n]
    s = np.matmul(q, k.transpose(0, 2, 1), out=room("looks", windows, n - begin, n))
    s += np.where(back >= 0, tables["near"][np.clip(back, 0, CONTEXT - 1)], -1e9).astype(np.float32)
    if mask is not None:
        s += mask[:, None, :]
    s, total, _ = exponentials(s, room("shares", *s.shape))
    s /= total[..., None]
    h = room("hidden", windows, n - begin, 2 * WIDTH)
    np.matmul(s, v, out=h[..., :WIDTH])
    h[..., WIDTH:] = x[:, begin:]
    z = np.matmul(h.reshape(-1, 2 * WIDTH), tables["out"], out=room("values", windows * (n - begin), CLASSES + 1))
    z += tables["bias"]
    return z, (q, k, v, s, h)


def forward(tables: dict, x: np.ndarray, mask: np.ndarray):
    """Class log-probabilities at every position of windows ``x`` (windows, positions, width), looking at itself and back."""
    room = Room()
    z, made = class_values(tables, np.ascontiguousarray(x), room, mask=mask)
    _, total, shift = exponentials(z, room("weights", *z.shape))
    z -= (np.log(total) + shift)[:, None]
    return z.reshape(*x.shape[:2], -1), made


def gradients(tables: dict, x: np.ndarray, goals: np.ndarray, begins: np.ndarray, room: Room) -> dict:
    """Of the mean cross-entropy of the goals (-1: none), by table; ``begins`` marks positions that hold the start vector."""
    windows, n, _ = x.shape
    z, (q, k, v, s, h) = class_values(tables, x, room)
    dz, total, _ = exponentials(z, room("weights", *z.shape))
    goals = goals.ravel()
    valid = goals >= 0
    share = np.float32(1 / max(np.count_nonzero(valid), 1))
    dz *= np.where(valid, share / total, 0).astype(np.float32)[:, None]
    at = np.flatnonzero(valid)
    dz.ravel()[at * (CLASSES + 1) + goals[at]] -= share
    grads = {"out": h.reshape(-1, 2 * WIDTH).T @ dz, "bias": np.ones(len(dz), np.float32) @ dz}
    da = np.matmul(dz, tables["out"][:WIDTH].T, out=room("da", windows * n, WIDTH)).reshape(windows, n, WIDTH)
    dqkv = room("dqkv", windows, n, 3 * WIDTH)
    np.matmul(s.transpose(0, 2, 1), da, out=dqkv[..., 2 * WIDTH :])
    ds = np.matmul(da, v.transpose(0, 2, 1), out=room("ds", windows, n, n))
    ds -= np.einsum("wnd,wnd->wn", da, h[..., :WIDTH])[..., None]
    ds *= s
    back = BACK[:n, :n]
    by_place = (np.ones(windows, np.float32) @ ds.reshape(windows, -1)).reshape(n, n)
    grads["near"] = np.bincount(np.clip(back, 0, CONTEXT - 1).ravel(), weights=np.where(back >= 0, by_place, 0).ravel(), minlength=CONTEXT).astype(np.float32)
    np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[..., WIDTH : 2 * WIDTH])
    np.matmul(ds, k, out=dqkv[..., :WIDTH])
    of_inputs = x.reshape(-1, WIDTH).T @ dqkv.reshape(-1, 3 * WIDTH)
    grads |= {name: of_inputs[:, i * WIDTH : (i + 1) * WIDTH] for i, name in enumerate(("query", "key", "value"))}
    grads["query"] = grads["query"] * np.float32(WIDTH**-0.5)
    grads["start"] = dz[begins.ravel()].sum(axis=0) @ tables["out"][WIDTH:].T + dqkv[begins].sum(axis=0) @ input_weights(tables).T
    return grads


class Adam:
    """Gradient steps on tables, in place."""

    def __init__(self, tables: dict):
        self.tables, self.step = tables, 0
        size = sum(value.size for value in tables.values())
        self.first, self.second = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def take(self, grads: dict, rate: float) -> None:
        self.step += 1
        grad = np.concatenate([grads[name].ravel() for name in self.tables])
        self.first += 0.1 * (grad - self.first)
        self.second += 0.01 * (grad * grad - self.second)
        change = (rate * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.99**self.step)) + 1e-8)).astype(np.float32)
        begin = 0
        for value in self.tables.values():
            value -= change[begin : begin + value.size].reshape(value.shape)
            begin += value.size


def windows_of(place: np.ndarray, goal: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that follow each other without overlap: word numbers (-1: start, -2: none) and the classes that come next (-1: none).

    ``place`` holds the words of all texts, ``goal`` the class by word, ``first`` where each text begins."""
    n_words = np.diff(first)
    n_windows = n_words // CONTEXT + 1  # a text has its words and a start mark as positions
    begin = np.cumsum(n_windows) - n_windows
    words = np.full((int(n_windows.sum()), CONTEXT), -2)
    goals = np.full(words.shape, -1)
    at = np.arange(len(place)) - np.repeat(first[:-1], n_words) + np.repeat(begin, n_words) * CONTEXT
    words.ravel()[begin * CONTEXT] = -1
    words.ravel()[at + 1] = place
    goals.ravel()[at] = goal[place] if len(place) else goal[:0]
    goals.ravel()[begin * CONTEXT + n_words] = CLASSES
    return words, goals


def window_gradients(tables: dict, inputs: np.ndarray, words: np.ndarray, goals: np.ndarray, room: Room) -> dict:
    """``inputs`` are the vectors of the words and two rows behind them, for no word and for the start."""
    inputs[-1] = tables["start"]
    x = np.take(inputs, words, axis=0, out=room("inputs", *words.shape, WIDTH), mode="wrap")
    return gradients(tables, x, goals, words == -1, room)


def train_start(model: Model, docs, ids, rng) -> Model:
    """Weights that all blocks start from: a fixed number of steps on windows of the sample."""
    model.tables = start_tables(rng)
    if not docs:
        return model
    if ids:
        flat, starts, lengths = flattened(ids)
        target = model.classes_of(flat, starts, lengths)
        vectors = model.vectors_of(flat, starts, lengths)
    else:
        target, vectors = np.zeros(0, np.int64), np.zeros((0, WIDTH), np.float32)
    inputs = np.concatenate([vectors, np.zeros((2, WIDTH), np.float32)])
    first = np.cumsum([0, *map(len, docs)])
    words, goals = windows_of(np.fromiter(chain.from_iterable(docs), np.int64, int(first[-1])), target, first)
    model.tables["bias"][:] = np.log(np.bincount(goals[goals >= 0], minlength=CLASSES + 1) + 1.0)
    adam, room = Adam(model.tables), Room()
    for step in range(1, ROUNDS + 1):
        pick = rng.integers(0, len(words), BATCH)
        adam.take(window_gradients(model.tables, inputs, words[pick], goals[pick], room), 0.01 * min(1.0, 2 * (1 - step / (ROUNDS + 1))))
    return model


# --- counting -------------------------------------------------------------------------------------------------------

COUNTS = "block long, word long, n long, ids binary"  # without a block: a subword and its sums of company
ID_BYTES = 2  # subword ids of a vocabulary of up to 65,536


class Words:
    """Subword ids of words by their hash, remembered from block to block of one worker."""

    def __init__(self, path: str):
        self.subwords = Subwords(path)
        self.keys, self.ids = np.zeros(0, np.uint64), pa.array([], pa.binary())

    def of(self, hashes: np.ndarray, text_of) -> pa.Array:
        """Of distinct words in the order of their hashes; ``text_of(i)`` gives the bytes of the i-th one."""
        if len(self.keys):
            known = self.keys[np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)] == hashes
        else:
            known = np.zeros(len(hashes), dtype=bool)
        missing = np.flatnonzero(~known)
        if len(missing):
            flat, starts, _ = flattened(self.subwords.ids([text_of(i) for i in missing]))
            ends = pa.py_buffer((ID_BYTES * np.append(starts, len(flat))).astype(np.int32))
            ids = pa.Array.from_buffers(pa.binary(), len(missing), [None, ends, pa.py_buffer(flat.astype(np.uint16))])
            at = np.searchsorted(self.keys, hashes[missing])
            order = np.insert(np.arange(len(self.keys)), at, len(self.keys) + np.arange(len(missing)))
            self.keys, self.ids = np.insert(self.keys, at, hashes[missing]), pa.concat_arrays([self.ids, ids]).take(pa.array(order))
        out = self.ids.take(pa.array(np.searchsorted(self.keys, hashes)))
        if len(self.keys) > CACHED_WORDS:
            self.keys, self.ids = hashes, out
        return out


_workers: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """One per worker process and vocabulary."""
    if path not in _workers:
        _workers.clear()
        _workers[path] = Words(path)
    return _workers[path]


def subwords_of(ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword ids of words in a row, where each word starts, and how many each has."""
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1] // ID_BYTES
    flat = np.frombuffer(ids.buffers()[2], np.uint16)[ends[0] : ends[-1]].astype(np.int64) if ids.buffers()[2] is not None else np.zeros(0, np.int64)
    return flat, ends[:-1] - ends[0], np.diff(ends).astype(np.int64)


def places_in(keys: np.ndarray):
    """A function that gives the places of hashes in sorted keys that hold them all: from where keys of their leading bits begin, key by key."""
    shift = np.uint64(64 - len(keys).bit_length())
    begin = np.searchsorted(keys >> shift, np.arange(1 << len(keys).bit_length(), dtype=np.uint64))

    def of(hashes: np.ndarray) -> np.ndarray:
        at = begin[(hashes >> shift).astype(np.int64)]
        left = np.flatnonzero(keys[at] != hashes)
        while len(left):
            at[left] += 1
            left = left[keys[at[left]] != hashes[left]]
        return at

    return of


def distinct_words(table: pa.Table) -> Iterator[tuple[tokens.Piece, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of lower-cased words with their distinct hashes, an example of each, and the place of each word's hash."""
    for piece in tokens.pieces(table.column("text"), lower=True):
        key = np.unique(piece.hashes)
        place = places_in(key)(piece.hashes)
        example = np.empty(len(key), np.int64)
        example[place] = np.arange(len(place))
        yield piece, key, example, place


def count_block(path: str, company: Company):
    def run(table: pa.Table) -> pa.Table:
        teaches = ~table.column("held_out").to_numpy()
        hashes, counts, texts, company_of = [np.array([END])], [np.array([teaches.sum()])], [None], []
        for piece, key, example, place in distinct_words(table):
            doc = piece.document_of_word()
            teaching = teaches[piece.rows][doc]
            hashes.append(key)
            counts.append(np.bincount(place[teaching], minlength=len(key)))
            texts.append((piece.data.tobytes().lower(), piece.starts[example], piece.ends[example]))  # bytes.lower changes A-Z only
            company_of.append((len(texts) - 1, doc[teaching], place[teaching], int(teaches[piece.rows].sum())))
        begin = np.cumsum([0, *map(len, hashes)])
        key, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        n = np.bincount(place, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
        part = np.searchsorted(begin, first, "right") - 1

        def text_of(i: int) -> bytes:
            if not part[i]:
                return b""  # the end
            lowered, starts, ends = texts[part[i]]
            word = first[i] - begin[part[i]]
            return lowered[starts[word] : ends[word]]

        ids = words_of(path).of(key, text_of)
        flat, starts, lengths = subwords_of(ids)
        for number, doc, word, n_docs in company_of:
            words = place[begin[number] : begin[number + 1]][word]
            each = lengths[words]
            at = np.arange(int(each.sum())) + np.repeat(starts[words] - (np.cumsum(each) - each), each)
            company.add(np.repeat(doc, each), flat[at], n_docs)
        return pa.table({
            "block": pa.array(np.full(len(key), table.column("block")[0].as_py()), pa.int64()), "word": pa.array(key.view(np.int64)), "n": pa.array(n), "ids": ids,
        })

    return run


def company_rows(company: Company) -> pa.RecordBatch:
    """The sums of one task; row -1 holds the number of documents."""
    used = np.flatnonzero(company.sums[:, -1])
    sums = [x.tobytes() for x in company.sums[used]]
    return pa.RecordBatch.from_arrays([
        pa.nulls(len(used) + 1, pa.int64()), pa.array([-1, *used], pa.int64()), pa.array([company.docs, *np.zeros(len(used), np.int64)], pa.int64()), pa.array([b"", *sums], pa.binary()),
    ], names=["block", "word", "n", "ids"])


def added_company(table: pa.Table) -> pa.Table:
    """Sums of company over the tasks."""
    word, n = table.column("word").to_numpy(), table.column("n").to_numpy()
    values = np.stack([np.frombuffer(x, np.float64) if x else np.zeros(WIDTH + 3) for x in table.column("ids").to_pylist()])
    order = np.lexsort((*values.T, n, word))  # sums in one order whatever the rows' was
    begin = np.flatnonzero(np.diff(word[order], prepend=word[order[0]] - 1))
    return pa.table({
        "word": pa.array(word[order][begin]), "n": pa.array(np.add.reduceat(n[order], begin)),
        "ids": pa.array([x.tobytes() for x in np.add.reduceat(values[order], begin, axis=0)], pa.binary()),
    })


def count_batches(path: str, basis):
    """Counts where the texts lie: each batch by the blocks it holds, so no text is moved to be counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        company = Company(basis.value)
        of_block = count_block(path, company)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for block in pc.unique(table.column("block")):
                yield from of_block(table.filter(pc.equal(table.column("block"), block))).to_batches()
        if company.docs:
            yield company_rows(company)

    return run


KINDS = ("tokens", "distinct", "once")


def class_cells(shared):
    """What a task's distinct training words add to sums by class, numbered below 0, and to the cells of spelling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            model, n = shared.value, batch.column(1).to_numpy()
            end = batch.column(0).to_numpy().view(np.uint64) == END
            flat, starts, lengths = subwords_of(batch.column(2))
            classes = np.where(end, CLASSES, model.classes_of(flat, starts, lengths))
            sums = [np.bincount(classes, weights=x, minlength=CLASSES + 1) for x in (n, np.ones(len(n)), n == 1)]
            cells, counts = np.unique(spelling_cells(model, flat, starts, lengths)[np.repeat(~end, lengths)], return_counts=True)
            cell = np.concatenate([-1 - np.arange(len(KINDS) * (CLASSES + 1)), cells])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([*sums, counts]).astype(np.int64))], names=["cell", "n"])

    return run


# --- attention weights ----------------------------------------------------------------------------------------------


PACES = "block long, windows long, tables binary"
TABLES = ("query", "key", "value", "out", "bias", "start", "near")
RATE = 0.004  # of the first step in a block


def packed(tables: dict) -> np.ndarray:
    return np.concatenate([tables[name].ravel() for name in TABLES]).astype(np.float64)


def unpacked(values: np.ndarray, like: dict) -> dict:
    cuts = np.cumsum([like[name].size for name in TABLES])[:-1]
    return {name: x.reshape(like[name].shape).astype(np.float32) for name, x in zip(TABLES, np.split(values, cuts), strict=True)}


def train_block(shared):
    """Weights after steps on all windows of a block's texts, times their number."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "windows": pa.array([], pa.int64()), "tables": pa.array([], pa.binary())})
        model = shared.value
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        keys, _, flat, starts, lengths = block_words(known)
        classes = model.classes_of(flat, starts, lengths)
        inputs = np.concatenate([model.vectors_of(flat, starts, lengths), np.zeros((2, WIDTH), np.float32)])
        tables = {name: value.copy() for name, value in model.tables.items()}
        adam, room, total = Adam(tables), Room(), 0
        size = max(pc.sum(pc.utf8_length(docs.column("text"))).as_py(), 1)
        done, places = 0, places_in(keys)
        for piece in tokens.pieces(docs.column("text"), lower=True):
            words, goals = windows_of(places(piece.hashes), classes, piece.first)
            order = np.random.default_rng(len(words)).permutation(len(words))
            for begin in range(0, len(order), BATCH):
                pick = np.sort(order[begin : begin + BATCH])
                share = len(pick) / BATCH  # the last batch of a piece is smaller
                adam.take(window_gradients(tables, inputs, words[pick], goals[pick], room), RATE * share * max(1 - done / size, 0.05))
                done += len(piece.data) * len(pick) // max(len(order), 1)
            total += len(words)
        return pa.table({"block": docs.column("block").slice(0, 1), "windows": pa.array([total], pa.int64()), "tables": pa.array([(total * packed(tables)).tobytes()], pa.binary())})

    return run


def added_tables(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    values = np.stack([np.frombuffer(x, np.float64) for x in table.column("tables").to_pylist()])
    return pa.table({"block": table.column("block").slice(0, 1), "windows": pa.array([sum(table.column("windows").to_pylist())], pa.int64()), "tables": pa.array([values.sum(axis=0).tobytes()], pa.binary())})


# --- scoring --------------------------------------------------------------------------------------------------------


@dataclass
class Totals:
    tokens: int
    distinct: int
    once: np.ndarray  # words that the training documents hold once, by class
    of_class: np.ndarray  # tokens by class


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def block_words(known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a block's words in order, their counts, and their subword ids as by ``subwords_of``."""
    known = known.take(pa.array(np.argsort(known.column("word").to_numpy().view(np.uint64)))).combine_chunks()
    ids = pa.concat_arrays(known.column("ids").chunks)
    return known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy(), *subwords_of(ids)


def score_block(shared, totals: Totals):
    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        model = shared.value
        keys, seen, flat, starts, lengths = block_words(known)
        class_of = np.where(keys == END, CLASSES, model.classes_of(flat, starts, lengths))
        vectors = model.vectors_of(flat, starts, lengths)
        spelled = model.spelled_of(flat, starts, lengths, np.minimum(class_of, len(model.spelling) - 1))
        base_of = lambda c: np.log10((c + 0.5) / (totals.tokens + 0.5 * (totals.distinct + 1)))
        of_class = np.maximum(totals.of_class, 1).astype(float)
        unseen = (totals.once + 0.5) / (totals.of_class + 1.0)  # share of each class that is left to unseen words
        within = np.where(seen > 0, np.log10(np.maximum(seen, 1) / of_class[class_of] * (1 - unseen[class_of])), np.log10(unseen[class_of]) + spelled)
        base = base_of(seen)
        end, places = np.searchsorted(keys, END), places_in(keys)
        out = {name: [] for name in ("n_tokens", "n_known", "base_score", "score")}
        for piece in tokens.pieces(docs.column("text"), lower=True):
            n_docs, place = len(piece.rows), places(piece.hashes)  # every word of the block is there
            doc = piece.document_of_word()
            add = lambda values, doc=doc, n_docs=n_docs: np.bincount(doc, weights=values, minlength=n_docs)
            out["n_tokens"].append(piece.counts() + 1)
            out["n_known"].append(add((seen > 0)[place].astype(float)).astype(np.int64) + int(seen[end] > 0))
            out["base_score"].append(add(base[place]) + base[end])
            out["score"].append(add(within[place]) + class_scores(model.tables, vectors, place, class_of, piece.first))
        flat = {name: np.concatenate([*parts, np.zeros(0)]) for name, parts in out.items()}
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(flat["n_tokens"].astype(np.int64)),
            "n_known": pa.array(flat["n_known"].astype(np.int64)), "base_score": pa.array(flat["base_score"]), "score": pa.array(flat["score"]),
        })

    return run


def class_scores(tables: dict, vectors: np.ndarray, place: np.ndarray, goal: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum over each text of the log10 probabilities of its words' classes and of its end, each token scored in one window."""
    n_docs = len(first) - 1
    # Position i of a text looks at its start mark and words 1..i and predicts word i + 1, or the end.
    length = np.diff(first) + 1
    begin = np.concatenate([[0], np.cumsum(length)])
    token = np.full(begin[-1], -1)
    target = np.full(begin[-1], CLASSES)
    at = np.arange(len(place)) + np.repeat(np.arange(n_docs), np.diff(first))
    token[at + 1] = place
    target[at] = goal[place] if len(place) else goal[:0]
    n_windows = 1 + np.maximum(0, -(-(length - CONTEXT) // STRIDE))
    doc = np.repeat(np.arange(n_docs), n_windows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    start = begin[doc] + nth * STRIDE
    result = np.zeros(n_docs)
    room = Room()
    for skipped, chosen in ((0, np.flatnonzero(nth == 0)), (CONTEXT - STRIDE, np.flatnonzero(nth))):  # positions that an earlier window has scored
        for a in range(0, len(chosen), SOME_WINDOWS):
            own = chosen[a : a + SOME_WINDOWS]
            at = start[own, None] + np.arange(CONTEXT)
            fresh = (at < begin[doc[own] + 1][:, None])[:, skipped:]
            at = np.minimum(at, begin[-1] - 1)
            x = np.take(vectors, token[at], axis=0, out=room("inputs", *at.shape, WIDTH), mode="wrap")
            x[token[at] == -1] = tables["start"]
            z, _ = class_values(tables, x, room, skipped)
            _, total, shift = exponentials(z, room("weights", *z.shape))
            picked = z.ravel()[np.arange(len(z)) * (CLASSES + 1) + target[at[:, skipped:]].ravel()] - (np.log(total) + shift)
            picked = (picked / np.log(10)).reshape(fresh.shape)
            result += np.bincount(doc[own], weights=np.where(fresh, picked, 0).sum(axis=1), minlength=n_docs)
    return result


def held_out(doc_id: Column) -> Column:
    return in_fold(doc_id, 5, 1)


def score_texts(docs: DataFrame, tokenizer_path: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    ship(spark)
    given = docs.select(
        F.coalesce(F.floor(F.col(doc_id) / BLOCK_IDS).cast("long"), -1 - F.pmod(F.xxhash64(text), F.lit(NULL_BLOCKS))).alias("block"), F.col(doc_id).cast("long").alias("doc_id"),
        held_out(F.col(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rng = np.random.default_rng(1)
    # Ids are drawn first, so that only the texts of the sample travel.
    teaching = given.where(~F.col("held_out") & F.col("doc_id").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id")
    drawn = teaching.orderBy(F.xxhash64(F.lit("lm"), "doc_id"), "doc_id").limit(SAMPLE).distinct()
    texts = given.join(F.broadcast(drawn), "doc_id").select("doc_id", "text").collect()  # at most SAMPLE ids
    subwords = Subwords(tokenizer_path)
    docs_in, ids_in = sample_words([row.text for row in sorted(texts)], subwords)
    basis = start_basis(docs_in, ids_in, subwords.size, rng)

    # Words by block, with their counts over the corpus; the sums of company ride along.
    counted = given.select("block", "held_out", "text").mapInArrow(count_batches(tokenizer_path, spark.sparkContext.broadcast(basis)), COUNTS)
    of_word = Window.partitionBy("word", F.col("block").isNull()).orderBy("block")
    all_of_word = of_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = pinned(counted.select("block", "word", "ids", F.when(F.col("block").isNull(), F.col("n")).otherwise(F.sum("n").over(all_of_word)).alias("n"), (F.row_number().over(of_word) == 1).alias("first")))
    by_block = known.where("block is not null").select("block", "word", "n", "ids")
    company = Company(basis)
    for row in known.where("block is null").groupBy(F.pmod("word", F.lit(64)).alias("part")).applyInArrow(added_company, "word long, n long, ids binary").collect():  # one row per subword
        if row.word < 0:
            company.docs = row.n
        else:
            company.sums[row.word] = np.frombuffer(row.ids, np.float64)
    model = model_of(tokenizer_path, company, rng)

    # Sums by class and the spelling of words, over all distinct training words.
    words = known.where("block is not null and first and n > 0").select("word", "n", "ids")
    sums = words.mapInArrow(class_cells(spark.sparkContext.broadcast(model)), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most classes x subwords
    cell, n = sums.column("cell").to_numpy(), sums.column("n").to_numpy()
    by_class = np.zeros(len(KINDS) * (CLASSES + 1), np.int64)
    by_class[-1 - cell[cell < 0]] = n[cell < 0]
    of_class, distinct, once = by_class.reshape(len(KINDS), -1)
    totals = Totals(int(of_class.sum()), int(distinct.sum()), once, of_class)
    spelled_model(model, cell[cell >= 0], n[cell >= 0], int(distinct[:CLASSES].sum()), int(n[cell >= 0].sum()))

    # Attention weights: the mean of what the blocks learn from all their windows.
    train_start(model, docs_in, ids_in, rng)
    lessons = given.where(~F.col("held_out")).select("block", "doc_id", "text")
    learned = pinned(lessons.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(train_block(spark.sparkContext.broadcast(model)), PACES))
    parts = learned.groupBy(F.pmod("block", F.lit(64)).alias("part")).applyInArrow(added_tables, PACES).collect()  # at most 64 rows
    windows = sum(row.windows for row in parts)
    if windows:
        model.tables = unpacked(sum(np.frombuffer(row.tables, np.float64) for row in sorted(parts, key=lambda row: row.block)) / windows, model.tables)

    shared = spark.sparkContext.broadcast(model)
    scored = given.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(score_block(shared, totals), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
