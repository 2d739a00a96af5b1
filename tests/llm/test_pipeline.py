"""The five stages on a small corpus, each against plain Python."""

import random
from fractions import Fraction

import pytest
from plain import split
from pyspark.sql import functions as F

import corpus_pipeline
from eventlake.llm import surrogates, toxicity
from test_pipeline_copies import kept as one_of_each


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    common = [f"{a}{b}" for a in "bcdfgl" for b in ("ana", "ert", "ion", "ust", "oru", "ema", "ilo")]
    text = lambda n: [rng.choice(common) for _ in range(n)]
    item = " ".join(text(40))
    rows, labels = [], []
    for i in range(300):
        words = text(rng.randrange(30, 80))
        toxic = i % 5 == 0
        if toxic:
            words[3:3] = ["dolt", "oaf"]
        if i % 17 == 1:
            words[5:5] = item.split()
        if i % 13 == 2:
            words.append(f"p{i}q.77@mail.example.com")
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(400 + i, rows[i * 3 + 1][1], "en", "s0", 0) for i in range(10)] + [(500, None, None, None, None), (501, "", "en", "s1", 0)]
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    toxic, copies, clean, private, mixing = [stage for _, stage in corpus_pipeline.STAGES]
    kept = toxic(spark, docs, folder).cache()
    ids = {row.doc_id for row in kept.collect()}
    assert kept.columns == columns and not {i for i in ids if i < 300 and i % 5 == 0} and len(ids) >= 240
    one_each = copies(spark, kept, folder).cache()
    assert {row.doc_id for row in one_each.collect()} == one_of_each([(row.doc_id, row.text) for row in kept.collect()]) and one_each.columns == columns
    fair = clean(spark, one_each, folder).cache()
    assert {row.doc_id for row in fair.collect()} == {row.doc_id for row in one_each.collect() if row.doc_id >= 300 or row.doc_id % 17 != 1}
    hidden = private(spark, fair, folder).cache()
    before, after = ({row.doc_id: row.text for row in frame.collect()} for frame in (fair, hidden))
    assert hidden.columns == columns and before.keys() == after.keys()
    for i, text in before.items():
        found = list(surrogates.entities(text)) if text else []
        assert (after[i] != text) == bool(found) and not any(value in after[i] for _, _, _, value in found)
    mixed = {row.doc_id: row for row in mixing(spark, hidden, folder).collect()}
    assert mixed.keys() == after.keys() and all(row.size == len(split(after[i])) and row.taken <= 3 * row.size for i, row in mixed.items())
    assert {row.doc_id: row.taken for row in corpus_pipeline.run(spark, folder).collect()} == {i: row.taken for i, row in mixed.items()}


def test_names_and_limits():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "PII", "mixing"]
    assert (toxicity.REJECT, corpus_pipeline.COPY_SHINGLE, corpus_pipeline.COPY_THRESHOLD) == (0.3, 5, Fraction(4, 5))


CLASHES = ["_key", "_text", "_toxicity", "toxicity", "row_key", "_attempts", "attempts", "mark", "n_entities", "key", "score", "count", "component_id"]


def test_clashing_columns_repeated_ids_and_long_texts(spark, folder, tmp_path):
    """Columns pass all stages but the last with their values; ids that repeat and long texts do no harm."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = " ".join(f"u{i}" for i in range(20000))
    more = spark.createDataFrame([(700, long, "en", "s1", 0), (700, "one two three", None, None, 0), (701, "one two three", "en", "s1", 0), (None, long, "en", None, None)], docs.schema)
    docs = docs.unionByName(more).select("*", *[F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name) for name in CLASHES])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns[5:] == CLASHES
        for row in docs.collect():
            assert [row[name] for name in CLASHES] == [f"{name}-{'none' if row.doc_id is None else row.doc_id}" for name in CLASHES]
    ids = [row.doc_id for row in docs.collect()]
    assert 700 in ids and 701 not in ids and None in ids
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(ids)


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
