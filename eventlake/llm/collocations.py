r"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

Every word of a text starts a suffix of at most ``MOST_WORDS`` words inside its piece (pieces end at punctuation and line ends).
A task reads texts in chunks, combines equal suffixes of a chunk, and routes them by their leading words: all suffixes that
begin with the same two words of one language meet in one bucket. There a multikey three-way quicksort partitions pointers to them:
each step compares the word at the partition's depth with a pivot, the equal part goes one word deeper, the
others stay; all partitions of a bucket take a step at once, as numpy arrays. The size of an equal partition is the count of its
phrase. A partition whose size is below the least count is abandoned, as is all that it could still hold.

Leading words that are very common would fill a bucket. Those that hold more than a share of a bounded sample are routed by three
words (and by four, where three are as common); their own counts travel beside. The sample (``SAMPLE_ROWS`` rows as a rate) also
sets the number of buckets. It decides only where suffixes meet, never what is counted. Equal suffixes leave a chunk
once, so a bucket holds few rows for a phrase, however often it occurs.

Counts of frequent phrases are then joined for the cuts of each candidate, in exact decimals, and candidates inside almost
as frequent longer ones go. The last step ranks shares of a language first, and then what is left of all shares.

Cases: null texts are empty, a null language is ``und``. Repeated rows count each time. Texts without words, and
an empty table, give no rows. Word and language are compared as they are, A-Z in words lower-cased. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm import tokens
from eventlake.llm.columns import UPPER
from eventlake.llm.shipping import ship
from eventlake.session import pinned

MOST_WORDS = 4
LEAST = 30
SCALE = 2_000_000
COVERED = (100, 80)  # a candidate goes if 100 * f(longer) >= 80 * f(candidate)
TOP = 2000
UNKNOWN = "und"
CHUNK_BYTES = 5 << 20
SAMPLE_ROWS = 20_000
BUCKET_ROWS = 400_000
RANK_SHARES = 64
MOST_COMMON = 50_000  # leading words that are routed deeper, at most

# Characters that end a piece, and those between words.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b"\x20\x09"

ENDS = np.zeros(256, dtype=bool)
ENDS[list(PIECE_ENDS)] = True
BREAKS = ENDS.copy()
BREAKS[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a sequence from that of all but its last word."""
    return tokens.mixed(before * np.uint64(tokens.STEP) + word)


@dataclass
class Chunk:
    """Words of some documents: compact text, spans in it, word numbers, hashes, language and words left in the piece."""

    text: np.ndarray  # words in order, one space behind each
    starts: np.ndarray  # first byte of every word, with the total behind the last
    word: np.ndarray  # number of the word among the distinct ones, from 1
    hashes: np.ndarray
    lang: np.ndarray  # number of the language of every word
    left: np.ndarray  # words from here to the end of the piece, this one included, at most MOST_WORDS


def chunk_of(texts: pa.Array, langs: np.ndarray) -> Chunk | None:
    """Cut a piece at a time, so that arrays over bytes stay small."""
    letters, lengths, hashes, last, of = [], [], [], [], []
    for piece in tokens.pieces(texts, BREAKS, True):
        n = len(piece.starts)
        if not n:
            continue
        document = piece.document_of_word()
        ended = np.cumsum(ENDS[piece.data], dtype=np.int32)[piece.starts]
        ends = np.ones(n, dtype=bool)
        ends[:-1] = (document[1:] != document[:-1]) | (ended[1:] != ended[:-1])
        letters.append(LOWER[piece.data[~BREAKS[piece.data]]])
        lengths.append(piece.ends - piece.starts)
        hashes.append(piece.hashes)
        last.append(ends)
        of.append(langs[piece.rows[document]])
    if not lengths:
        return None
    letters, lengths, last = np.concatenate(letters), np.concatenate(lengths), np.concatenate(last)
    n = len(lengths)
    text = np.full(len(letters) + n, 0x20, dtype=np.uint8)
    text[np.arange(len(letters), dtype=np.int32) + np.repeat(np.arange(n, dtype=np.int32), lengths)] = letters
    solid = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(solid), pa.py_buffer(letters))
    number = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    ends = np.flatnonzero(last)
    left = np.minimum(np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n) + 1, MOST_WORDS)
    return Chunk(text, solid + np.arange(n + 1), number, np.concatenate(hashes), np.concatenate(of), left)


def chunks(batches: Iterator[pa.RecordBatch], numbers: dict[str, int]) -> Iterator[Chunk]:
    """Chunks of (lang, text) batches; ``numbers`` gets the languages in the order they come."""
    held, size = [], 0

    def build() -> Iterator[Chunk]:
        langs = np.concatenate([lang for lang, _ in held])
        made = chunk_of(pa.concat_arrays([text for _, text in held]), langs)
        if made is not None:
            yield made

    for batch in batches:
        names = [UNKNOWN if name is None else name for name in batch.column(0).to_pylist()]
        lang = np.array([numbers.setdefault(name, len(numbers)) for name in names], dtype=np.int64)
        text = batch.column(1).cast(pa.large_string()).fill_null("")
        row = 0
        while row < len(text):
            sizes = np.cumsum(np.diff(tokens.bytes_of(text[row:])[1]))
            upto = row + max(1, int(np.searchsorted(sizes, CHUNK_BYTES - size, "right")))
            held.append((lang[row:upto], text[row:upto]))
            size += int(sizes[upto - row - 1])
            row = upto
            if size >= CHUNK_BYTES or row < len(text):
                yield from build()
                held, size = [], 0
    if held:
        yield from build()


def prefixes(chunk: Chunk, rows: np.ndarray, roots: np.ndarray, depth: int) -> np.ndarray:
    """Hash of language and first ``depth`` words at the given places."""
    out = roots[chunk.lang[rows]]
    for i in range(depth):
        out = chained(out, chunk.hashes[rows + i])
    return out


def language_hashes(numbers: dict[str, int]) -> np.ndarray:
    """A hash per language that does not depend on the order in which they came."""
    out = np.zeros(len(numbers), dtype=np.uint64)
    for name, i in numbers.items():
        value = np.array([len(name)], dtype=np.uint64)
        for byte in name.encode():
            value = chained(value, np.uint64(byte + 1))
        out[i] = value[0]
    return out


def contains(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(wanted), dtype=bool)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


@dataclass
class Entries:
    """Distinct word sequences: a place where each begins, words, the least depth it counts for, how often, bucket."""

    place: np.ndarray
    words: np.ndarray
    least: np.ndarray
    count: np.ndarray
    route: np.ndarray

    @classmethod
    def joined(cls, parts: list[Entries]) -> Entries:
        return cls(*[np.concatenate([getattr(part, name) for part in parts]) for name in ("place", "words", "least", "count", "route")])


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row of every group of equal rows, and how many there are.

    Rows are sorted by the first column; the others tell rows apart that are equal in it by chance. A group that such
    a row cuts in two comes twice, which adds up later."""
    order = np.argsort(columns[0])
    new = np.ones(len(order), dtype=bool)
    new[1:] = False
    for column in columns:
        value = column[order]
        new[1:] |= value[1:] != value[:-1]
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def combined(chunk: Chunk, roots: np.ndarray, common: dict[int, np.ndarray]) -> Entries:
    """Every phrase of the chunk as few entries: the language, words, and suffixes from two words on, common leading words apart."""
    every = np.arange(len(chunk.word))
    parts = []

    def add(place: np.ndarray, words, least: int, count: np.ndarray, route: np.ndarray) -> None:
        full = lambda x: np.broadcast_to(np.asarray(x, dtype=np.int64), place.shape)
        parts.append(Entries(place, full(words), full(least), count, route))

    def add_counts(rows: np.ndarray, hashes: np.ndarray, depth: int) -> None:
        one, count = grouped(hashes, *[chunk.word[rows + i] for i in range(depth)])
        add(rows[one], depth, depth, count, hashes[one])

    lang, count = grouped(chunk.lang)
    add(lang, 0, 0, count, roots[chunk.lang[lang]])
    single = prefixes(chunk, every, roots, 1)
    add_counts(every, single, 1)
    rows = np.flatnonzero(chunk.left >= 2)
    pair = chained(single[rows], chunk.hashes[rows + 1])
    words = chunk.left[rows]
    route, least, whole = pair, np.full(len(rows), 2), pair.copy()
    for depth in (3, 4):
        longer = np.flatnonzero(words >= depth)
        whole[longer] = chained(whole[longer], chunk.hashes[rows[longer] + depth - 1])
        hot = np.flatnonzero(contains(common[depth - 1], route) & (least == depth - 1))
        if len(hot):  # one word deeper; their own counts go beside
            add_counts(rows[hot], route[hot], depth - 1)
            route, least = route.copy(), least.copy()
            least[hot] = depth
            route[hot] = prefixes_or(chunk, rows[hot], roots, depth, route[hot])
    kept = np.flatnonzero(words >= least)  # what is too short was counted beside
    apart = [np.where(words[kept] > i, chunk.word[np.minimum(rows[kept] + i, len(every) - 1)], 0) for i in range(MOST_WORDS)]
    one, count = grouped(tokens.mixed(whole[kept] + words[kept].astype(np.uint64)), *apart)
    one_of = kept[one]
    parts.append(Entries(rows[one_of], words[one_of], least[one_of], count, route[one_of]))
    return Entries.joined(parts)


def prefixes_or(chunk: Chunk, rows: np.ndarray, roots: np.ndarray, depth: int, otherwise: np.ndarray) -> np.ndarray:
    """Hashes of ``depth`` leading words where there are as many."""
    out = otherwise.copy()
    longer = chunk.left[rows] >= depth
    out[longer] = prefixes(chunk, rows[longer], roots, depth)
    return out


def texts_of(chunk: Chunk, place: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries' words, one line each, and the end of every line; an entry without words is an empty line."""
    first = chunk.starts[place]
    length = np.where(words > 0, chunk.starts[place + words] - first, 1)
    ends = np.cumsum(length)
    out = chunk.text[np.repeat(first - (ends - length), length) + np.arange(ends[-1])]
    out[ends - 1] = 0x0A
    return out, ends


SLAB = 100_000


def packed(chunk: Chunk, entries: Entries, buckets: int, names: list[str]) -> Iterator[tuple[int, str, bytes]]:
    """(bucket, language, entries as bytes): number of entries, least depths, counts, lines."""
    bucket = (tokens.mixed(entries.route) % np.uint64(buckets)).astype(np.int64)
    lang = chunk.lang[entries.place]
    order = np.argsort((bucket * len(names) + lang) * (len(chunk.word) + 1) + chunk.word[entries.place])  # leading words together: lines that compress
    for slab in range(0, len(order), SLAB):
        rows = order[slab : slab + SLAB]
        text, ends = texts_of(chunk, entries.place[rows], entries.words[rows])
        least, count = entries.least[rows].astype(np.uint8), entries.count[rows].astype(np.int64)
        key = bucket[rows] * len(names) + lang[rows]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(rows)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            begin = ends[a - 1] if a else 0
            body = np.int64(b - a).tobytes() + least[a:b].tobytes() + count[a:b].tobytes() + text[begin : ends[b - 1]].tobytes()
            yield int(bucket[rows[a]]), names[lang[rows[a]]], body


def routed(docs: DataFrame, buckets: int, common: dict[int, np.ndarray]) -> DataFrame:
    """(bucket, lang, entries) of (lang, text) rows."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most MOST_COMMON hashes a depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        for chunk in chunks(batches, numbers):
            names, held, size = list(numbers), [], 0
            for row in packed(chunk, combined(chunk, language_hashes(numbers), shared.value), buckets, names):
                held.append(row)
                size += len(row[2])
                if size > 4 << 20:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    def batch_of(rows: list) -> pa.RecordBatch:
        bucket, lang, body = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(lang, pa.string()), pa.array(body, pa.binary())], names=["bucket", "lang", "entries"])

    return docs.mapInArrow(run, "bucket long, lang string, entries binary")


def common_prefixes(docs: DataFrame, rate: float) -> tuple[dict[int, np.ndarray], int]:
    """Hashes of two and three leading words that a share of a sample begins with, and the number of buckets.

    A task of the sample reports what holds the share in one of its chunks, so it reports a bounded number a chunk."""
    spark = docs.sparkSession
    least_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        for chunk in chunks(batches, numbers):
            roots, out = language_hashes(numbers), [(0, 0, len(chunk.word))]
            for depth in (2, 3):
                rows = np.flatnonzero(chunk.left >= depth)
                key, count = np.unique(prefixes(chunk, rows, roots, depth), return_counts=True)
                many = count >= max(8, len(chunk.word) / (8 * least_buckets))
                out += [(depth, int(k), int(n)) for k, n in zip(key[many].view(np.int64), count[many], strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("depth", "prefix", "n"), row, strict=True)) for row in out], schema=FOUND)

    FOUND = pa.schema([("depth", pa.int64()), ("prefix", pa.int64()), ("n", pa.int64())])
    sample = docs if rate >= 1 else docs.sample(rate, seed=11)
    found = sample.mapInArrow(run, "depth long, prefix long, n long").groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    got = found.orderBy(F.desc("n"), "prefix").limit(2 * MOST_COMMON + 1).collect()
    words = sum(row.n for row in got if row.depth == 0)
    buckets = max(least_buckets, int(words / min(rate, 1) / BUCKET_ROWS) + 1)
    hot = lambda depth: np.sort(np.array([r.prefix for r in got if r.depth == depth and r.n >= words / (4 * least_buckets)], dtype=np.int64).view(np.uint64))
    return {2: hot(2), 3: hot(3)}, buckets


def partitions(words: np.ndarray, weight: np.ndarray, least: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(pointer, depth, count) of every equal partition that counts ``most`` or more.

    ``words`` has a row per sequence, 0 behind its end. A sequence counts for depths from ``least`` on.
    Multikey three-way quicksort: ``order`` holds the pointers, ``bounds`` the partitions still open, ``depth`` their depth.
    """
    order = np.arange(len(words))
    bounds, depth = np.array([0, len(words)]), np.zeros(1, dtype=np.int64)
    while len(order):
        size = np.diff(bounds)
        part = np.repeat(np.arange(len(size)), size)
        key = words[order, depth[part]]
        low, high = bounds[:-1], bounds[1:] - 1
        pivot = np.sort(np.stack([key[low], key[(low + high) // 2], key[high]]), axis=0)[1]
        side = (key > pivot[part]).astype(np.int64) - (key < pivot[part]) + 1
        # Three-way split of every partition at once: a stable counting sort by (partition, side).
        ranks, sizes = [], []
        for way in range(3):
            mine = side == way
            upto = np.concatenate([[0], np.cumsum(mine)])
            ranks.append(upto[:-1] - upto[low][part])
            sizes.append(upto[bounds[1:]] - upto[low])
        sizes = np.stack(sizes, axis=1)
        begin = low[:, None] + np.cumsum(sizes, axis=1) - sizes
        to = begin[part, side] + np.where(side == 1, ranks[1], np.where(side == 0, ranks[0], ranks[2]))
        sorted_order = np.empty_like(order)
        sorted_order[to] = order
        sizes, begin = sizes.ravel(), begin.ravel()
        equal = np.tile([False, True, False], len(depth))
        deeper = np.repeat(depth, 3) + equal
        total = np.concatenate([[0], np.cumsum(weight[sorted_order])])
        held = total[begin + sizes] - total[begin]
        ended = equal & (np.repeat(pivot, 3) == 0)
        kept = np.flatnonzero((held >= most) & ~ended)
        for i in kept[equal[kept]]:
            rows = sorted_order[begin[i] : begin[i] + sizes[i]]
            count = int(weight[rows[least[rows] <= deeper[i]]].sum())
            if count >= most:
                yield int(rows[0]), int(deeper[i]), count
        kept = kept[deeper[kept] < words.shape[1]]
        rows = np.repeat(begin[kept] - np.concatenate([[0], np.cumsum(sizes[kept])])[:-1], sizes[kept]) + np.arange(sizes[kept].sum())
        order, bounds, depth = sorted_order[rows], np.concatenate([[0], np.cumsum(sizes[kept])]), deeper[kept]


def unpacked(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Word numbers (0 behind the end), least depths and counts of every entry, and the words."""
    least, count, sizes, lines = [], [], [], []
    for body in bodies:
        n = int(np.frombuffer(body, np.int64, 1)[0])
        least.append(np.frombuffer(body, np.uint8, n, 8))
        count.append(np.frombuffer(body[8 + n : 8 + 9 * n], np.int64, n))
        lines.append(body[8 + 9 * n :])
        sizes.append(n)
    data = np.frombuffer(b"".join(lines), dtype=np.uint8)
    gap = (data == 0x20) | (data == 0x0A)
    closed = np.flatnonzero(gap)
    opened = np.concatenate([[0], closed[:-1] + 1])
    real = closed > opened  # an entry without words is an empty line
    line = np.concatenate([[0], np.cumsum(data[closed] == 0x0A)[:-1]])
    first = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1])
    column = np.arange(len(closed)) - first[line]
    solid = np.concatenate([[0], np.cumsum((closed - opened)[real])]).astype(np.int64)
    encoded = pa.LargeStringArray.from_buffers(int(real.sum()), pa.py_buffer(solid), pa.py_buffer(np.ascontiguousarray(data[~gap]))).dictionary_encode()
    words = np.zeros((sum(sizes), MOST_WORDS), dtype=np.int32)
    words[line[real], column[real]] = encoded.indices.to_numpy() + 1
    return words, np.concatenate(least).astype(np.int64), np.concatenate(count), encoded.dictionary


GRAMS = "lang string, k int, phrase string, f long"
GRAM_TYPE = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def alive(words: np.ndarray, least: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences that may still be part of a frequent phrase, cut behind their last word that occurs often enough at its depth."""
    words, rows = words.copy(), np.arange(len(words))
    for depth in range(words.shape[1]):
        rare = np.bincount(words[:, depth], weights=count, minlength=1) < most
        rare[0] = True
        gone = rare[words[:, depth]]
        words[gone, depth:] = 0
        kept = ~gone | (least <= depth)
        words, least, count, rows = words[kept], least[kept], count[kept], rows[kept]
    return rows, words


def frequent_in(least: int):
    """Phrases of one bucket that occur ``least`` times or more."""

    def run(table: pa.Table) -> pa.Table:
        bodies: dict[str, list[bytes]] = {}
        for name, body in zip(table.column("lang").to_pylist(), table.column("entries").to_pylist(), strict=True):
            bodies.setdefault(name, []).append(body)
        out = []
        for name, own in bodies.items():
            words, lo, count, dictionary = unpacked(own)
            size = int(count[lo == 0].sum())
            if size >= least:
                out.append((name, 0, "", size))
            rows, cut = alive(words, lo, count, least)
            for row, depth, n in partitions(cut, count[rows], lo[rows], least):
                out.append((name, depth, " ".join(dictionary[int(w) - 1].as_py() for w in cut[row, :depth]), n))
        return pa.table([pa.array(column, field.type) for column, field in zip(zip(*out, strict=True) if out else [()] * 4, GRAM_TYPE, strict=True)], schema=GRAM_TYPE)

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, k, phrase, f): every phrase of at most ``MOST_WORDS`` words that occurs ``least`` times in a language; k = 0 counts its words."""
    given = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = given.count()
    common, buckets = common_prefixes(given, SAMPLE_ROWS / max(rows, 1))
    return routed(given, buckets, common).groupBy("bucket").applyInArrow(frequent_in(least), GRAMS)


def exact_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)); the product is a decimal of up to 38 digits."""
    wide = lambda x: x.cast("decimal(20,0)")
    product = F.lit(SCALE).cast("decimal(10,0)") * wide(a)
    total = (wide(l) + wide(r)).cast("decimal(21,0)")
    return F.call_function("div", product, total).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language."""
    ship(docs.sparkSession)
    grams = pinned(frequent_phrases(docs, least, text, lang))
    words = F.split("phrase", " ")
    part = lambda first, length: F.array_join(F.slice(words, first, length), " ")
    candidates = grams.where("k >= 2").withColumnRenamed("f", "a")
    cuts = candidates.select("lang", "phrase", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left_part"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right_part"))
    counts = lambda name, f: grams.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(counts("left_part", "l"), ["lang", "left_part"]).join(counts("right_part", "r"), ["lang", "right_part"])
    scored = cuts.select("lang", "phrase", "a", F.struct(exact_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r").alias("one"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min("one").alias("one"))
    # Every shorter phrase inside a candidate, with the most that a longer one around it counts.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: part(i, n))))
    around = candidates.where("k >= 3").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    apart = lowest.join(around, ["lang", "phrase"], "left").where(F.coalesce(COVERED[0] * wide("longer") < COVERED[1] * wide("a"), F.lit(True)))
    # The best of each share of a language's phrases, then the best of these: no task ranks all phrases of a language.
    best = apart.select("lang", "phrase", "a", "one.l", "one.r", "one.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES)).alias("share"))
    order = "ORDER BY score DESC, a DESC, phrase"
    best = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, share {order})")).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})"))
    sizes = grams.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _sql() -> str:
    grams = "\n  UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(words[i:i + {k - 1}], ' ') AS phrase, count(*) AS f FROM (SELECT lang, words, unnest(range(1, len(words) - {k - 2})) AS i FROM piece WHERE len(words) >= {k}) GROUP BY ALL HAVING count(*) >= {LEAST}"
        for k in range(1, MOST_WORDS + 1)
    )
    return rf"""
WITH piece AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS words FROM (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\n\x0B\f\r]')) AS p FROM documents)
), total AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM piece GROUP BY lang
), gram AS MATERIALIZED (
  {grams}
), cut AS (
  SELECT g.lang, phrase, f AS a, unnest(range(1, k)) AS c, string_split(phrase, ' ') AS w FROM gram g WHERE k >= 2
), scored AS (
  SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, c, CAST({SCALE}::HUGEINT * a // (x.f + y.f) AS BIGINT) AS score FROM cut
  JOIN gram x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:c], ' ') JOIN gram y ON y.lang = cut.lang AND y.phrase = array_to_string(w[c + 1:], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), apart AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM gram g WHERE g.lang = s.lang AND g.k > len(string_split(s.phrase, ' ')) AND contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' ') AND {COVERED[0]} * g.f >= {COVERED[1]} * s.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM apart JOIN total USING (lang)
QUALIFY rank <= {TOP}
"""


SQL = _sql()
