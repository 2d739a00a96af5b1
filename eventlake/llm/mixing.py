"""Mixing sources to target weights by drawing fixed-length token blocks.

Every source is one long stream of words: its documents in a fixed order, cut into blocks of
``block_words`` words. The output is a row of shards, each with ``shard_slots`` slots. A shard
draws multinomial counts of its slots per source, by systematic resampling: one random offset per
shard is laid over the cumulative source shares, so a count differs from its expectation by less
than one. The slots of a source are numbered through all shards; slot ``i`` takes block
``permutation(i mod blocks)`` of its source, a pseudorandom permutation of the block numbers, so no
block comes again before all others of its source have come. Slots then meet blocks in a join by
source and block number.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words; a
target stops at three times the words of its source, and the excess is shared anew by weight until
no target is above. That is ``min(cap, level * weight)`` with one common level. A slot number past
the third pass of its source, which rounding can give, stays empty: no document is taken more than
three times.

A source that holds much of the data is placed by buckets: prefix sums run inside a bucket of
documents and over bucket totals, never over a whole source in one task. All draws are hashes of
fixed seeds, so reruns agree.

Cases: null or empty texts have size 0 and are taken 0 times; a null source is a source of its own;
repeated rows are documents of their own; a source without words has target 0. An empty table
gives no rows. Documents of one id in one source are told apart by their texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.columns import unit_hash, words_of
from eventlake.session import pinned

MOST_TIMES = 3
WEIGHTS = 3
# Prime step of the block permutation; it shares no factor with a smaller block count.
STEP = 1_000_000_000_039
MILLION = 1_000_000


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target for every source of ``sized`` (source, size)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1)).orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ordered = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    cap = MOST_TIMES * F.col("source_size")
    ranked = sums.withColumn("weight", (F.row_number().over(ordered) - 1) % WEIGHTS + 1).withColumns({
        "total": F.sum("source_size").over(everything),
        "reached": cap / F.col("weight"),
    })
    # Sources full at a level are the first in order of cap per weight; later ones give lower levels.
    rising = Window.partitionBy(F.lit(1)).orderBy("reached", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    levels = ranked.withColumn(
        "level", (F.col("total") - F.coalesce(MOST_TIMES * F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    )
    found = levels.withColumn("level", F.max(F.when(F.col("level") <= F.col("reached"), F.col("level"))).over(everything))
    return found.select(
        "source", "source_size", F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def placed(sized: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """``sized`` with ``first_word``, the place of each document in the stream of its source."""
    cut = sized.withColumn("_bucket", F.pmod(F.coalesce(F.col(order[0]), F.lit(0)), F.lit(buckets)))
    totals = cut.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("source", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("first_word", F.col("_offset") + F.col("_before"))
        .drop("_bucket", "_before", "_source", "_b", "_offset")
    )


def drawn_slots(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """Counts drawn per output shard: source, shard, first (the source's slots before), slots."""
    shares = targets.where("target > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    # Slots a source needs so that blocks of its mean length add up to its target, in whole millionths.
    shares = shares.withColumn("wanted", F.round(F.col("target") * F.col("blocks") / F.col("source_size") * MILLION).cast("long"))
    ordered = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.sum("wanted").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    # The slots of shard k are the numbers k * shard_slots + j, their points (j + offset of k) * sum of wanted / all slots.
    lined = shares.select(
        "source", "blocks", (upto - F.col("wanted")).alias("low"), upto.alias("high"), F.sum("wanted").over(everything).alias("all")
    ).withColumn("slots_all", F.greatest(F.round(F.col("all") / MILLION), F.lit(1.0)))
    shards = lined.withColumn("shard", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots_all") - 1) / shard_slots).cast("int"))))
    size = F.least(F.lit(float(shard_slots)), F.col("slots_all") - F.col("shard") * shard_slots)
    offset = unit_hash(F.lit("shard"), F.lit(seed), F.col("shard"))
    # Points of a shard are offset, 1 + offset, ...; those below x number ceil(x - offset).
    points = lambda edge: F.ceil(F.col(edge) / F.col("all") * size - offset)
    counted = shards.withColumn("slots", F.greatest(points("high") - points("low"), F.lit(0)))
    earlier = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("first", F.coalesce(F.sum("slots").over(earlier), F.lit(0))).select(
        "source", "shard", "blocks", "first", "slots"
    )


def permuted(number: Column, blocks: Column, source: Column, seed: int) -> Column:
    """Block that the ``number``-th place of a pass over ``blocks`` blocks takes."""
    start = F.floor(unit_hash(F.lit("start"), F.lit(seed), F.coalesce(source, F.lit(""))) * blocks)
    wide = (number.cast("decimal(19,0)") * F.lit(STEP).cast("decimal(19,0)") + start.cast("decimal(19,0)")) % blocks.cast("decimal(19,0)")
    return wide.cast("long")


def mixed_blocks(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """Every filled slot of the mix: source, shard, slot, block."""
    counts = drawn_slots(targets, block_words, shard_slots, seed).where("slots > 0").repartition("source", "shard")
    slots = counts.select("source", "shard", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("slots") - 1)).alias("slot"))
    kept = slots.where(F.col("slot") < MOST_TIMES * F.col("blocks"))
    return kept.select(
        "source", "shard", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("source"), seed).alias("block")
    )


def mix(
    docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; ``taken`` counts repeats."""
    sized = pinned(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"),
        F.xxhash64(text).alias("mark"), F.monotonically_increasing_id().alias("_row"),
    ))
    targets = pinned(source_targets(sized))
    buckets = math.isqrt(sized.count()) + 1  # as many buckets as documents in one
    repeats = mixed_blocks(targets, block_words, shard_slots, seed).groupBy(F.col("source").alias("_source"), F.col("block").alias("_block"))
    repeats = repeats.agg(F.count(F.lit(1)).alias("times"))
    spans = placed(sized, ["doc_id", "mark", "_row"], buckets).where("size > 0")
    last_word = F.col("first_word") + F.col("size") - 1
    pieces = spans.select(
        "_row", "source", "first_word", last_word.alias("last_word"),
        F.explode(F.sequence(F.floor(F.col("first_word") / block_words), F.floor(last_word / block_words))).alias("block"),
    )
    inside = F.least("last_word", (F.col("block") + 1) * block_words - 1) - F.greatest("first_word", F.col("block") * block_words) + 1
    taken = (
        pieces.join(repeats.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
        .groupBy("_row")
        .agg(F.sum(inside * F.col("times")).alias("taken"))
    )
    rows = sized.join(taken, "_row", "left")
    known = targets.select(F.col("source").alias("_source"), "source_size", "target")
    return rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), marks AS (
  SELECT *, 3 * source_size / weight AS reached FROM sums
), levels AS (
  SELECT max(level) AS level FROM (
    SELECT m.reached, ((SELECT sum(source_size) FROM sums) - coalesce((SELECT sum(3 * b.source_size) FROM marks b
        WHERE (b.reached, b.source IS NULL, coalesce(b.source, '')) < (m.reached, m.source IS NULL, coalesce(m.source, ''))), 0))
      / (SELECT sum(b.weight) FROM marks b WHERE (b.reached, b.source IS NULL, coalesce(b.source, '')) >= (m.reached, m.source IS NULL, coalesce(m.source, ''))) AS level
    FROM marks m) WHERE level <= reached
), targets AS (
  SELECT source, source_size, weight, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM sums, levels
), shares AS (
  SELECT *, CAST(ceil(source_size / 64) AS BIGINT) AS blocks,
    CAST(round(target * CAST(ceil(source_size / 64) AS BIGINT) / source_size * 1000000) AS BIGINT) AS wanted
  FROM targets WHERE target > 0
), lined AS (
  SELECT source, blocks, wanted, sum(wanted) OVER (ORDER BY source NULLS LAST ROWS UNBOUNDED PRECEDING) AS high, sum(wanted) OVER () AS whole FROM shares
), sharded AS (
  SELECT *, least(4096.0, greatest(round(whole / 1000000), 1.0) - shard * 4096) AS n,
    CAST(('0x' || substr(md5('shard:7:' || shard), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS shift
  FROM lined, LATERAL (SELECT unnest(range(0, CAST(floor((greatest(round(whole / 1000000), 1.0) - 1) / 4096) AS BIGINT) + 1)) AS shard)
), counted AS (
  SELECT source, blocks, shard, greatest(CAST(ceil(CAST(high AS DOUBLE) / CAST(whole AS DOUBLE) * CAST(n AS DOUBLE) - shift) - ceil(CAST(high - wanted AS DOUBLE) / CAST(whole AS DOUBLE) * CAST(n AS DOUBLE) - shift) AS BIGINT), 0) AS slots FROM sharded
), totals AS (
  SELECT source, blocks, CAST(sum(slots) AS BIGINT) AS slots FROM counted GROUP BY source, blocks
), filled AS (
  SELECT source, CAST((CAST(slot % blocks AS HUGEINT) * 1000000000039
      + CAST(floor(CAST(('0x' || substr(md5('start:7:' || coalesce(source, '')), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE * blocks) AS HUGEINT)) % blocks AS BIGINT) AS block
  FROM totals, LATERAL (SELECT unnest(range(0, least(slots, 3 * blocks))) AS slot)
), repeats AS (
  SELECT source, block, count(*) AS times FROM filled GROUP BY source, block
), spans AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY doc_id % (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) + 1 FROM documents), doc_id ROWS UNBOUNDED PRECEDING) - size AS first_word
  FROM sized
), taken AS (
  SELECT s.doc_id, CAST(sum((least(first_word + size, (r.block + 1) * 64) - greatest(first_word, r.block * 64)) * times) AS BIGINT) AS taken
  FROM spans s JOIN repeats r ON s.source IS NOT DISTINCT FROM r.source AND r.block * 64 < s.first_word + s.size AND (r.block + 1) * 64 > s.first_word
  WHERE size > 0 GROUP BY s.doc_id
)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(taken, 0) AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (doc_id)
"""
