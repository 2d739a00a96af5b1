"""Benchmark decontamination by winnowing.

Fingerprints of a text are the k-gram hashes that are the least of some run of ``WINDOW - K + 1``
neighbouring k-grams (all of them on ties). Any ``WINDOW`` words that two texts share hold such a
run, so both texts keep the same fingerprint there: no shared window is missed. Fingerprints of
documents meet those of the items in a join; around each hit the two texts are compared word for
word, up to the words a window can reach, and where hit and extension give a whole window, its
words are hit. Hash collisions fall away in this comparison.

Items shorter than a window count as one window: their word counts (below ``WINDOW``, so few)
are read first, and word runs of those lengths are joined in full.

Cases: null or empty texts have no words, no hits, and are clean; an item without words has no
window; equal items are separate items. Item ids are compared as strings; a null item id is left
out of the list, its windows still hit. Every input row gives one row, repeated rows alike; rows
with a null id are told apart only by their texts. An empty benchmark leaves every document clean,
an empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.columns import ascii_lower, let
from eventlake.session import pinned

WINDOW = 13
K = 5
RUN = WINDOW - K + 1  # k-grams per window
REACH = WINDOW - K  # words a window can stick out on one side of a fingerprint
SHARE = 20  # contaminated when at least one word in SHARE is hit

# Words: ASCII digits, letters (lower-cased) and every character beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), lambda word: word != "")


def fingerprints(words: Column, k: int = K, run: int = RUN) -> Column:
    """Winnowed k-grams as an array of (hash, place from 0); none for texts shorter than a window.

    A gram is kept if it is the least of some run it lies in; equal ones are all kept. Elements are
    read one by one, as cutting an array copies it whole.
    """

    def kept(grams: Column) -> Column:
        least = F.transform(
            F.sequence(F.lit(0), F.size(grams) - run), lambda at: F.least(*[F.get(grams, at + i) for i in range(run)])
        )
        highest = lambda at, mins: F.greatest(*[F.get(mins, at - i) for i in range(run)])
        return let(least, lambda mins: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda at: F.get(grams, at) == highest(at, mins)),
            lambda at: F.struct(F.get(grams, at).alias("hash"), at.alias("place")),
        ))

    grams = F.transform(
        F.sequence(F.lit(0), F.size(words) - k), lambda at: F.xxhash64(*[F.get(words, at + i) for i in range(k)])
    )
    return F.when(F.size(words) >= k + run - 1, let(grams, kept))


def hit_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Word spans of documents that windows of items cover: key, first, last (from 1), item_id.

    ``docs`` is (key, text), ``items`` is (item_id, words). Only hits travel; the words of documents
    with hits are looked up again for the comparison.
    """
    item_prints = items.select("item_id", F.explode(let(F.col("words"), lambda words: F.transform(
        fingerprints(words), lambda p: F.struct(p["hash"].alias("hash"), around(words, p["place"]).alias("near"))
    ))).alias("print")).select(F.col("print.hash").alias("hash"), F.struct("item_id", "print.near").alias("item"))
    doc_prints = docs.select("key", F.explode(let(item_words(F.col("text")), fingerprints)).alias("print"))
    hits = doc_prints.select("key", F.col("print.hash").alias("hash"), F.col("print.place").alias("place")).join(item_prints, "hash")
    by_doc = hits.groupBy("key").agg(F.collect_list(F.struct("place", "item")).alias("hits"))

    def extended(words: Column) -> Column:
        def span(hit: Column) -> Column:
            there = hit["item"]["near"]
            return let(around(words, hit["place"]), lambda here: F.when(here["gram"] == there["gram"], let(
                F.struct(shared_run(here["before"], there["before"]).alias("left"), shared_run(here["after"], there["after"]).alias("right")),
                lambda run: F.when(run["left"] + run["right"] + K >= WINDOW, F.struct(
                    (hit["place"] + 1 - run["left"]).alias("first"), (hit["place"] + K + run["right"]).alias("last"), hit["item"]["item_id"].alias("item_id"),
                )),
            )))

        return F.array_compact(F.transform("hits", span))

    return docs.join(by_doc, "key").select("key", F.explode(let(item_words(F.col("text")), extended)).alias("span")).select("key", "span.*")


def around(words: Column, place: Column) -> Column:
    """The k-gram at ``place`` and the ``REACH`` words on both sides, going outward; null beyond the text."""
    return F.struct(
        F.array(*[F.get(words, place - 1 - i) for i in range(REACH)]).alias("before"),
        F.array(*[F.get(words, place + i) for i in range(K)]).alias("gram"),
        F.array(*[F.get(words, place + K + i) for i in range(REACH)]).alias("after"),
    )


def shared_run(one: Column, other: Column) -> Column:
    """Number of leading words that two arrays of ``REACH`` words share."""
    unlike = F.filter(
        F.sequence(F.lit(0), F.lit(REACH)), lambda i: (i == REACH) | ~F.coalesce(F.get(one, i) == F.get(other, i), F.lit(False))
    )
    return F.get(unlike, F.lit(0))


def short_spans(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """Spans where a whole short item occurs; None if no item is short."""
    short = items.where(F.size("words").between(1, WINDOW - 1))
    lengths = [row[0] for row in short.select(F.size("words")).distinct().collect()]  # below WINDOW values
    if not lengths:
        return None
    whole = short.select("item_id", F.col("words").alias("run"))

    def runs(n: int) -> DataFrame:
        rows = let(item_words(F.col("text")), lambda words: F.when(F.size(words) >= n, F.transform(
            F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda place: F.struct(place.alias("first"), F.array(*[F.get(words, place - 1 + i) for i in range(n)]).alias("run"))
        )))
        return docs.select("key", F.explode(rows).alias("at")).select("key", "at.first", (F.col("at.first") + n - 1).alias("last"), "at.run")

    every = reduce(DataFrame.unionByName, [runs(n) for n in sorted(lengths)])
    return every.join(whole, "run").select("key", "first", "last", "item_id")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, key, n_words, n_hit, n_items, item_ids, contaminated) of every document; ``key`` is its ``row_key``."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"))
    items = pinned(benchmark.select(F.col(item_id).cast("string").alias("item_id"), item_words(F.col(item_text)).alias("words")))
    spans = hit_spans(keyed, items)
    short = short_spans(keyed, items)
    if short is not None:
        spans = spans.unionByName(short)
    # Distinct spans first: repeated rows give the same ones, and a window that several fingerprints found counts once.
    spans = spans.distinct()
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("first", "last"))),
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda seen, span: F.struct(
            F.greatest(seen["upto"], span["last"]).alias("upto"),
            (seen["n"] + F.greatest(span["last"] - F.greatest(seen["upto"], span["first"] - 1), F.lit(0))).alias("n"),
        ),
        lambda seen: seen["n"],
    )
    found = spans.groupBy("key").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count_distinct("item_id").alias("n_items"))
    sizes = keyed.select("doc_id", "key", F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return sizes.join(found, "key", "left").select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows of one id and one text are one document."""
    return F.struct(F.coalesce(doc_id.cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("mark"))


def digest(judged: DataFrame) -> DataFrame:
    ids = F.sha2(F.concat_ws(",", "item_ids"), 256)
    return judged.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n, array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS run
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(words) - 13, 0) + 2)) AS i) WHERE len(words) > 0
), dw AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS run
  FROM d, (SELECT DISTINCT n FROM bw) lengths, LATERAL (SELECT unnest(range(1, greatest(len(words) - n + 2, 1))) AS i)
), hits AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.run = bw.run AND dw.n = bw.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
