"""Every operator over documents: further columns of clashing names, null and repeated ids, null, empty and very long texts, empty tables."""

import pytest
from pyspark.sql import functions as F

from eventlake.llm import collocations, decontaminate, jaccard_join, language_model, mixing, quality, spotsigs, substring_dedup, toxicity

NAMES = [
    "_key", "_text", "_toxicity", "_attempts", "mark", "n_entities", "key", "block", "word", "n", "size", "score", "family", "component", "place", "met", "first",
    "high", "low", "_row", "_bucket", "_source", "bucket", "entries", "phrase", "f", "held_out", "fingerprint", "next_text", "n_words", "grade", "toxic", "item_id", "count",
]
LONG = " ".join(f"w{i % 700}x{i % 13}" for i in range(20000))
ROWS = [
    (1, "the cat sat on the mat, and the dog lay there"), (1, "the cat sat on the mat, and the dog lay there"), (1, "another text under one id"), (2, None), (3, ""), (4, LONG),
    (None, "the cat sat on the mat, and the dog lay there"), (None, None), (5, LONG + " end"), (6, "!!! ..."), (7, "a"),
]


def of_labels(run):
    def with_labels(docs):
        rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 8)]
        return run(docs, docs.sparkSession.createDataFrame(rows, "doc_id long, quality int, toxic int"))

    return with_labels


def contamination(docs):
    items = docs.sparkSession.createDataFrame([(1, "the cat sat on the mat, and the dog lay there"), (2, "a"), (3, None)], "item_id long, text string")
    return decontaminate.digest(decontaminate.contamination(docs, items))


OPERATORS = {
    "op1": lambda docs: substring_dedup.repeated_spans(docs).drop("removed_spans"),
    "op2": language_model.score_texts,
    "op4": jaccard_join.linked_components,
    "op5": mixing.mix,
    "op7": of_labels(toxicity.judge),
    "op8": contamination,
    "op9": of_labels(quality.select),
    "op10": spotsigs.edited_pairs,
    "op11": lambda docs: collocations.collocations(docs, least=2),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_odd_rows(spark, documents, monkeypatch, name):
    monkeypatch.setattr(language_model, "ROUNDS", 5)
    docs = documents(*ROWS)
    plain = OPERATORS[name](docs)
    clashing = OPERATORS[name](docs.select("*", *[F.lit(f"{column}!").alias(column) for column in NAMES]))
    rows = lambda frame: sorted((tuple(row) for row in frame.collect()), key=str)
    got = rows(plain)
    assert plain.columns == clashing.columns and got == rows(clashing)
    assert len(got) == len(ROWS) or name == "op11" and got


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(documents, monkeypatch, name):
    monkeypatch.setattr(language_model, "ROUNDS", 5)
    assert OPERATORS[name](documents()).count() == 0
