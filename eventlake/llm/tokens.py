"""Words of Arrow text columns as numpy arrays: spans, hashes and rolling hashes of word runs.

Everything works on the raw UTF-8 bytes of a batch, so a word costs a few array operations and no
Python object. Hashes are 64 bits wide, fixed by constants, and the same on every run and machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
PIECE_BYTES = 1 << 20

# The two ways of cutting words: at ASCII white space, or at every ASCII character but digits and letters.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
MARKS = np.zeros(256, dtype=bool)
MARKS[:0x80] = True
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the input spread over the output (a bijection on 64 bits)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    codes = np.arange(256, dtype=np.uint64)
    if lower:
        codes[0x41:0x5B] += np.uint64(0x20)
    return mixed((codes + np.uint64(1)) * np.uint64(STEP)) | np.uint64(1)


VALUES = {lower: _byte_values(lower) for lower in (False, True)}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & MASK, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BYTE_POWERS = _powers(0xD6E8FEB86659FD93, 1 << 16)


@dataclass
class Piece:
    """A few whole documents: row numbers in the batch, bytes, word spans, hashes and words per document."""

    rows: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first word of each document, with the total behind the last

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), self.counts())

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, ends


def pieces(column: pa.Array, breaks: np.ndarray = WHITE, lower: bool = False) -> Iterator[Piece]:
    """The documents of a column in pieces of a bounded number of bytes; a longer text is a piece of its own."""
    data, offsets = bytes_of(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, "right")) - 1)
        yield cut(data[offsets[row] : offsets[upto]], offsets[row : upto + 1] - offsets[row], np.arange(row, upto), breaks, lower)
        row = upto


def cut(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, breaks: np.ndarray, lower: bool) -> Piece:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Piece(rows, data, none, none, np.zeros(0, np.uint64), np.zeros(len(rows) + 1, np.int64))
    inside = ~breaks[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    opened, closed = inside.copy(), inside.copy()
    opened[1:] &= ~inside[:-1] | edge[1:-1]
    closed[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opened), np.flatnonzero(closed) + 1
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Piece(rows, data, starts, ends, np.zeros(0, np.uint64), first)
    values = VALUES[lower][data]
    values[~inside] = 0
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(data))
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    values *= BYTE_POWERS[place & 0xFFFF]
    hashes = mixed(np.add.reduceat(values, starts) + (ends - starts).astype(np.uint64) * np.uint64(STEP))
    return Piece(rows, data, starts, ends, hashes, first)


def runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` neighbouring hashes; shorter input gives none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = np.uint64((0xA24BAED4963EE407 + 2 * salt) & MASK)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= step
        out += hashes[i : i + n]
    return mixed(out + np.uint64((salt + 1) * STEP & MASK))
