"""SpotSigs fingerprints: chains of content words behind common-word anchors.

Every occurrence of a common word (an anchor) opens a spot; the next ``CHAIN`` content words among
the ``REACH`` words behind it, common words passed over, form its signature together with the
anchor. A text's fingerprint is the sorted set of its signature hashes as hexadecimal text, so the
likeness of two texts, the Jaccard similarity of their sets, can be read from fingerprints alone.
Anchors sit where running prose is, not where lists and navigation are.

``near_pairs`` joins fingerprints: sets are partitioned by size, sets of sizes too far apart never
meet, and within a partition two sets meet only where their prefixes share a signature; the
prefix is so long that any pair at the threshold shares one. Pairs whose sizes already rule the
threshold out are pruned before their sets are compared.

Cases: a text without a spot has one signature, the hash of its words, and none if it has no words
either; two empty fingerprints have likeness 1, an empty and another one 0. Null counts as an empty
text. Equal texts have equal fingerprints. In ``edited_pairs`` documents follow one another by id,
a null id first, rows of one id by their texts; equal rows stand for one, and every input row gets
its result. An empty table gives no rows; further columns are not carried.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.columns import ascii_lower, let
from eventlake.session import pinned

CHAIN = 2
REACH = 8

# Anchors: frequent function words of the four languages of the corpus.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to",
    "was", "with", "auf", "das", "dem", "den", "der", "des", "die", "ein", "ist", "mit", "nicht", "und", "von", "zu", "con", "de",
    "del", "el", "es", "la", "las", "lo", "los", "para", "por", "que", "un", "una", "y", "dans", "du", "est", "et", "il", "le",
    "les", "ne", "pas", "pour", "qui", "sur", "une",
)

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spot_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BREAKS), lambda word: word != "")


def signatures(text: Column) -> Column:
    """Sorted distinct signature hashes (32 bits each) of a text that is not null."""

    def spots(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda at: F.get(words, at).isin(*ANCHORS))
        behind = lambda at: F.array(*[F.get(words, at + i) for i in range(1, REACH + 1)])
        content = lambda at: F.filter(behind(at), lambda word: word.isNotNull() & ~word.isin(*ANCHORS))
        found = F.transform(places, lambda at: let(
            content(at), lambda chain: F.hash(F.get(words, at), *[F.get(chain, F.lit(i)) for i in range(CHAIN)])
        ))
        return let(found, lambda hashes: F.when(F.size(hashes) > 0, F.array_sort(F.array_distinct(hashes))).otherwise(F.array(F.hash(words))))

    empty = F.array().cast("array<int>")
    return let(spot_words(text), lambda words: F.when(F.size(words) > 0, spots(words)).otherwise(empty))


def fingerprint(hashes: Column) -> Column:
    """A signature set as text."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    shared = F.size(F.array_intersect(one, other)).cast("double")
    return let(shared, lambda n: F.when(F.size(one) + F.size(other) == 0, F.lit(1.0)).otherwise(n / (F.size(one) + F.size(other) - n)))


def near_pairs(signed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (low, high, likeness) of distinct sets of ``signed`` (key, hashes) that reach the threshold.

    Rows of equal sets stand for one, the least key. Empty sets have no partner.
    """
    sets = pinned(signed.where(F.size("hashes") > 0).groupBy("hashes").agg(F.min("key").alias("key")).withColumn("n", F.size("hashes")))
    frequency = sets.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    ranked = sets.select("key", "n", F.explode("hashes").alias("hash")).join(frequency.hint("merge"), "hash")
    rarest = ranked.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("order"))
    prefix = F.slice("order", 1, F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1)
    # Partition b holds sizes in [threshold ** -b, threshold ** -(b + 1)); partners lie in the same or a neighbouring one.
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-log(threshold)))
    probes = rarest.select("key", "n", F.explode(prefix).alias("spot"), band.alias("band")).select("key", "n", "band", "spot.hash")
    left = probes.select(F.col("key").alias("low"), F.col("n").alias("low_n"), "band", "hash")
    right = probes.select(F.col("key").alias("high"), F.col("n").alias("high_n"), F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "hash")
    pruned = (F.col("low") < F.col("high")) & (F.least("low_n", "high_n") >= F.greatest("low_n", "high_n") * threshold)
    met = left.join(right, ["band", "hash"]).where(pruned).select("low", "high").distinct()
    compared = met.join(sets.select(F.col("key").alias("low"), F.col("hashes").alias("low_set")), "low").join(
        sets.select(F.col("key").alias("high"), F.col("hashes").alias("high_set")), "high"
    )
    return compared.select("low", "high", likeness(F.col("low_set"), F.col("high_set")).alias("likeness")).where(F.col("likeness") >= threshold)


def successors(keys: DataFrame) -> DataFrame:
    """``keys`` (key, ...) with ``next_key`` in ascending order, the first key behind the last.

    Cut by rows over tasks: neighbours meet inside a range, and only the least key of each range
    travels to the range before.
    """
    ranged = pinned(keys.repartitionByRange("key").withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("next_key", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    heads = ranged.groupBy("part").agg(F.min("key").alias("head"))
    upward = Window.orderBy("part")
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("part", F.coalesce(F.lead("head").over(upward), F.min("head").over(everything)).alias("following"))
    return inside.join(following, "part").withColumn("next_key", F.coalesce("next_key", "following")).drop("part", "following")


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document against its edited text and against the next document.

    The edited text ends in the start of the next document instead of its own last quarter.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # A key that sorts as (id, text mark); one document per key.
    keyed = texts.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("key"), "text")
    signed = pinned(keyed.select("key", F.length("text").alias("n_chars"), signatures(F.col("text")).alias("hashes")))
    chain = pinned(successors(signed.select("key", "n_chars").distinct()))
    # The start of the next document that each document takes, cut where that document lies.
    wanted = chain.select(F.col("next_key").alias("key"), F.col("key").alias("taker"), F.floor(F.col("n_chars") / 4).cast("int").alias("cut"))
    starts = keyed.join(wanted.hint("merge"), "key").select("taker", "cut", F.substring("text", F.lit(1), F.col("cut")).alias("head"))
    heads = starts.groupBy(F.col("taker").alias("key")).agg(F.first("cut").alias("cut"), F.first("head").alias("head"))
    edited = keyed.join(heads, "key").select(
        "key", F.concat(F.substring("text", F.lit(1), F.length("text") - F.col("cut")), F.col("head")).alias("edited")
    )
    edits = edited.select("key", F.sha2("edited", 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_hashes"))
    sets = signed.groupBy("key").agg(F.first("n_chars").alias("n_chars"), F.first("hashes").alias("hashes"))
    behind = chain.select(F.col("key").alias("taker"), F.col("next_key").alias("key"))
    following = sets.join(behind, "key").select(F.col("taker").alias("key"), F.col("hashes").alias("next_hashes"))
    rows = edits.join(sets, "key").join(following, "key")
    return rows.select(
        F.col("key.doc_id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        fingerprint(F.col("hashes")).alias("fingerprint"), fingerprint(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
