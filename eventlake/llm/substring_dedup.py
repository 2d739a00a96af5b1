"""Substring dedup by De Bruijn compaction.

A repeated span is a path of repeated edges in the De Bruijn graph of the corpus. Nodes are token ``K``-mers, kept
sparsely: of every run of ``RUN`` neighbouring k-mers the one with the least hash (a choice that depends on their
words alone). An edge leads from a kept k-mer to the next one and stands for all words between them. Any
``WINDOW`` words hold two disjoint runs, so two equal windows hold the same two kept k-mers at least, and with them a common edge.

1. Edges are counted over the corpus in a shuffle; blocks of documents combine their own repeats first. Only
   repeated edges come back to the block, each with its source, the coordinates of its first occurrence.
2. Where neighbouring edges of a document have neighbouring sources, the path between them does not branch: it
   compacts to one span that occurs word for word at its source. All windows inside are repeats, without being looked up.
3. Windows that hold the first occurrence of an edge are firsts. What remains are windows at the ends of compacted
   spans and where sources change; they are looked up by a 128-bit hash among all windows that could be their
   source, again combined per block.
4. Words that a repeated window covers are removed.

Blocks are ranges of document ids, so a passage that a third of all documents share is one row per block in a shuffle.

Cases: texts of fewer words than a window lose nothing; null and empty texts have no words and the hash of the empty text.
Documents are ordered by id, a null id first; rows of one id are told apart by their texts, and equal rows are one document
(both get its result). Every input row gives one row, an empty table none; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm import tokens
from eventlake.llm.shipping import ship
from eventlake.session import pinned

WINDOW = 20
K = 5
RUN = (WINDOW - K + 1) // 2
BLOCK_IDS = 1024
LEAST_ID = -(1 << 63)


class Text:
    """One piece of documents with its edges."""

    def __init__(self, piece: tokens.Piece):
        self.piece, self.first = piece, piece.first
        words = piece.hashes
        grams = tokens.runs(words, K)
        n = len(words)
        doc = piece.document_of_word()
        last = self.first[1:][doc] if n else np.zeros(0, np.int64)  # end of the document of each word
        self.doc, self.last = doc, last
        # Least gram of each run that lies in one document, the rightmost on ties.
        starts = np.flatnonzero(np.arange(n) + K + RUN - 1 <= last)
        if len(starts):
            near = np.lib.stride_tricks.sliding_window_view(grams, RUN)[starts]
            least = starts + RUN - 1 - near[:, ::-1].argmin(axis=1)
        else:
            least = np.zeros(0, np.int64)
        kept = np.unique(least)
        self.least = np.full(n, -1)  # the gram kept for the run that starts at a word
        self.least[starts] = least
        both = doc[kept[1:]] == doc[kept[:-1]] if len(kept) else np.zeros(0, bool)
        self.begin, self.end = kept[:-1][both], kept[1:][both] + K  # words [begin, end) of each edge
        step = tokens._powers(0x9FB21C651E98DF25, n + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * step[:-1])])
        back = tokens._powers(pow(0x9FB21C651E98DF25, -1, 1 << 64), n + 1)
        self.edge = tokens.mixed((sums[self.end] - sums[self.begin]) * back[self.begin] + (self.end - self.begin).astype(np.uint64))

    def place(self, word: np.ndarray) -> np.ndarray:
        """Places of words in their documents."""
        return word - self.first[:-1][self.doc[word]] if len(word) else word


def documents_of(table, offset: int = 0) -> Iterator[tuple[tokens.Piece, np.ndarray]]:
    order = np.lexsort((table.column("mark").to_numpy(), table.column("id").to_numpy()))
    table = table.take(pa.array(order))
    ids = np.stack([table.column("id").to_numpy(), table.column("mark").to_numpy()], axis=1)
    # Equal rows are one document.
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]).any(axis=1)
    table, ids = table.filter(pa.array(fresh)), ids[fresh]
    for piece in tokens.pieces(table.column("text")):
        yield piece, ids[piece.rows]


def firsts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each comes first, and how often it comes."""
    return np.unique(keys, return_index=True, return_counts=True)


EDGES = "block long, edge long, id long, mark long, place int, many boolean"


def edges_of_block(table: pa.Table) -> pa.Table:
    """Edges of a block of documents: each once, at its first occurrence."""
    keys, ids, places = [], [], []
    for piece, own in documents_of(table):
        text = Text(piece)
        keys.append(text.edge)
        ids.append(own[text.doc[text.begin]] if len(text.begin) else own[:0])
        places.append(text.place(text.begin))
    key, at, n = firsts_of(np.concatenate([*keys, np.zeros(0, np.uint64)]))
    id_, place = np.concatenate([*ids, np.zeros((0, 2), np.int64)])[at], np.concatenate([*places, np.zeros(0, np.int64)])[at]
    block = table.column("block")[0].as_py() if table.num_rows else 0
    return pa.table({
        "block": pa.array(np.full(len(key), block), pa.int64()), "edge": pa.array(key.view(np.int64)), "id": pa.array(id_[:, 0]), "mark": pa.array(id_[:, 1]),
        "place": pa.array(place.astype(np.int32)), "many": pa.array(n > 1),
    })


SPANS = "id long, mark long, n_words int, text string, kept_sha256 string, removed binary, ask_high array<long>, ask_low array<long>, ask_place array<int>, asks array<boolean>"
SPAN_TYPE = pa.schema([
    ("id", pa.int64()), ("mark", pa.int64()), ("n_words", pa.int32()), ("text", pa.string()), ("kept_sha256", pa.string()), ("removed", pa.binary()),
    ("ask_high", pa.list_(pa.int64())), ("ask_low", pa.list_(pa.int64())), ("ask_place", pa.list_(pa.int32())), ("asks", pa.list_(pa.bool_())),
])


def spans_of_block(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Per document: words removed so far, and the windows that must be compared with other blocks."""
    order = np.argsort(known.column("edge").to_numpy().view(np.uint64))
    edges = known.column("edge").to_numpy().view(np.uint64)[order]
    source = np.stack([known.column(c).to_numpy()[order] for c in ("id", "mark", "place")], axis=1) if len(order) else np.zeros((0, 3), np.int64)
    rows, seen = [], {}
    for piece, own in documents_of(docs):
        text = Text(piece)
        words, n = piece.hashes, len(piece.hashes)
        at = np.minimum(np.searchsorted(edges, text.edge), max(len(edges) - 1, 0))
        repeated = edges[at] == text.edge if len(edges) else np.zeros(len(text.edge), bool)
        begin_doc = text.doc[text.begin] if len(text.begin) else np.zeros(0, np.int64)
        place = text.place(text.begin)
        where = source[at] if len(edges) else np.zeros((len(text.edge), 3), np.int64)
        here = repeated & (where[:, 0] == own[begin_doc, 0]) & (where[:, 1] == own[begin_doc, 1]) & (where[:, 2] == place)
        # Edges between the grams kept for the first and for the last run of each window; they depend on its words alone.
        start = np.flatnonzero(np.arange(n) + WINDOW <= text.last) if n else np.zeros(0, np.int64)
        low = np.searchsorted(text.begin, text.least[start])
        high = np.searchsorted(text.end, text.least[start + WINDOW - (K + RUN - 1)] + K, "right")
        upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        fresh, own_first = upto(~repeated), upto(here)
        whole = fresh[high] == fresh[low]  # every edge in the window is repeated
        is_first = own_first[high] > own_first[low]
        # Compacted path: neighbouring edges, neighbouring sources, and not at home.
        joined = np.zeros(len(text.edge), bool)
        if len(text.edge) > 1:
            joined[1:] = (
                repeated[1:] & repeated[:-1] & ~here[1:] & ~here[:-1] & (begin_doc[1:] == begin_doc[:-1])
                & (where[1:, 0] == where[:-1, 0]) & (where[1:, 1] == where[:-1, 1]) & (where[1:, 2] - where[:-1, 2] == place[1:] - place[:-1])
            )
        path = np.cumsum(~joined) - 1
        path_begin, path_end = text.begin[~joined], text.end[np.append(np.flatnonzero(~joined)[1:] - 1, len(joined) - 1)] if len(joined) else text.end
        sure = np.zeros(len(start), bool)
        if len(joined):
            of = path[np.minimum(low, len(path) - 1)]
            inside = (low < high) & (path_begin[of] <= start) & (path_end[of] >= start + WINDOW)
            # A window may begin before its first edge and still lie in the path of the edge before.
            prior = path[np.maximum(low - 1, 0)]
            inside |= (low > 0) & (path_begin[prior] <= start) & (path_end[prior] >= start + WINDOW)
            away = repeated & ~here
            sure = inside & whole & (upto(away)[high] - upto(away)[low] == high - low)
        removed = np.zeros(len(start), bool)
        removed[sure] = True
        open_ = np.flatnonzero(whole & ~sure)
        one = tokens.runs(words, WINDOW)[start[open_]] if len(open_) else np.zeros(0, np.uint64)
        two = tokens.runs(words, WINDOW, salt=1)[start[open_]] if len(open_) else np.zeros(0, np.uint64)
        # Within the block: later occurrences are repeats already, and first ones are looked up elsewhere.
        keep = np.zeros(len(open_), bool)
        for i, key in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
            if key in seen:
                removed[open_[i]] = True
            else:
                seen[key] = keep[i] = True
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, start[removed], 1)
        np.add.at(covered, start[removed] + WINDOW, -1)
        gone = np.cumsum(covered)[:n] > 0
        doc_of_open = text.doc[start[open_[keep]]] if len(open_) else np.zeros(0, np.int64)
        asked = text.place(start[open_[keep]]) if len(open_) else np.zeros(0, np.int64)
        asks = ~is_first[open_[keep]]
        cuts = np.searchsorted(doc_of_open, np.arange(len(own) + 1))
        for d in range(len(own)):
            a, b = int(piece.first[d]), int(piece.first[d + 1])
            x, y = cuts[d], cuts[d + 1]
            final = not asks[x:y].any()
            rows.append({
                "id": own[d, 0], "mark": own[d, 1], "n_words": b - a, "kept_sha256": kept_hash(piece, a, b, gone) if final else None,
                "text": None if final else b" ".join(piece.word(i) for i in range(a, b)).decode(),
                "removed": np.packbits(gone[a:b]).tobytes(), "ask_high": one[keep][x:y].view(np.int64), "ask_low": two[keep][x:y].view(np.int64),
                "ask_place": asked[x:y].astype(np.int32), "asks": asks[x:y],
            })
    return pa.Table.from_pylist(rows, schema=SPAN_TYPE)


def kept_hash(piece: tokens.Piece, a: int, b: int, gone: np.ndarray) -> str:
    return hashlib.sha256(b" ".join([piece.word(i) for i in range(a, b) if not gone[i]])).hexdigest()


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the windows that other blocks turned out to hold first."""
    for batch in batches:
        n_removed, hashes, spans = [], [], []
        for row in batch.to_pylist():
            gone = np.unpackbits(np.frombuffer(row["removed"], np.uint8), count=row["n_words"]).astype(bool)
            for place in row["late"] or ():
                gone[place : place + WINDOW] = True
            if row["kept_sha256"] is None:
                words = row["text"].split(" ")
                row["kept_sha256"] = hashlib.sha256(" ".join([w for w, g in zip(words, gone, strict=True) if not g]).encode()).hexdigest()
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            n_removed.append(int(gone.sum()))
            hashes.append(row["kept_sha256"])
            spans.append(edge.reshape(-1, 2).tolist())
        ids = batch.column(batch.schema.get_field_index("id")), batch.column(batch.schema.get_field_index("mark"))
        words = batch.column(batch.schema.get_field_index("n_words"))
        yield pa.RecordBatch.from_arrays(
            [*ids, words, pa.array(n_removed, pa.int64()), pa.array(hashes, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int32())))],
            names=["id", "mark", "n_words", "n_removed", "kept_sha256", "removed_spans"],
        )


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed_spans) of every document.

    ``removed_spans`` holds first and last-but-one word numbers of what is removed, in order.
    """
    ship(docs.sparkSession)
    id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST_ID))
    mark = F.xxhash64(text)
    given = docs.select(F.floor(id_ / BLOCK_IDS).cast("long").alias("block"), id_.alias("id"), mark.alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = given.groupBy("block").applyInArrow(edges_of_block, EDGES)
    # One row per block and edge; the first over all blocks is the source.
    of_edge = Window.partitionBy("edge")
    sourced = found.withColumns({
        "blocks": F.count(F.lit(1)).over(of_edge), "any": F.max("many").over(of_edge), "source": F.min(F.struct("id", "mark", "place")).over(of_edge),
    })
    known = sourced.where((F.col("blocks") > 1) | F.col("any")).select("block", "edge", "source.id", "source.mark", "source.place")
    spans = pinned(given.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(spans_of_block, SPANS))

    windows = spans.where(F.size("ask_place") > 0).select(
        "id", "mark", F.explode(F.arrays_zip("ask_high", "ask_low", "ask_place", "asks")).alias("w")
    ).select("id", "mark", "w.*")
    of_window = Window.partitionBy("ask_high", "ask_low")
    earliest = F.min(F.struct("id", "mark", "ask_place")).over(of_window)
    late = windows.withColumn("earliest", earliest).where(F.col("asks") & (F.col("earliest") != F.struct("id", "mark", "ask_place")))
    by_doc = late.groupBy("id", "mark").agg(F.collect_list("ask_place").alias("late"))
    rows = spans.select("id", "mark", "n_words", "text", "kept_sha256", "removed").join(by_doc, ["id", "mark"], "left")
    done = rows.mapInArrow(finished, "id long, mark long, n_words int, n_removed long, kept_sha256 string, removed_spans array<array<int>>")
    out = given.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("id", "mark", "copies")
    again = done.join(out, ["id", "mark"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    return again.select(
        F.when(F.col("id") != LEAST_ID, F.col("id")).alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), "n_removed", "kept_sha256", "removed_spans"
    )


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS run FROM w, LATERAL (SELECT unnest(range(1, greatest(len(words) - 18, 1))) AS i)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM later, LATERAL (SELECT unnest(range(i, i + 20)) AS p)
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY u.p) AS text FROM w, LATERAL (SELECT unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p) u
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.p = u.p) GROUP BY w.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""
