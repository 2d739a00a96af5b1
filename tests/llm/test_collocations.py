"""Collocations against counting everything."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlake.llm import collocations
from plain import UPPER

DOCS = "lang string, text string"


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
    candidates = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    out = {}
    for (lang, *w), a in candidates.items():
        cuts = [(2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = lambda g: any(list(g[i : i + len(w)]) == w for i in range(1, len(g) - len(w) + 1))
        if not any(g[0] == lang and len(g) > len(w) + 1 and 100 * b >= 80 * a and inside(g) for g, b in candidates.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score) for lang, found in out.items() for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top])
    )


def mined(spark, rows, **named):
    df = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("n", F.lit(0))
    return sorted(tuple(row) for row in collocations.collocations(df, **named).collect())


def draw(n, seed=1):
    """Texts over a small vocabulary with repeated phrases, in a few languages."""
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "a", "New", "york", "City", "é", "ünder", "x\x00y", "<s>", "\x1f", "of"]
    marks = [" ", " ", "  ", "\t", ". ", ", ", "\n", " ; ", "!", "\x0b"]
    text = lambda: "".join(f"{vocabulary[w]}{marks[m]}" for w, m in zip(rng.zipf(1.4, 60) % len(vocabulary), rng.integers(0, len(marks), 60), strict=True))
    langs = ["en", "en", "en", "fr", None, "l a\tng"]
    return [(langs[i % len(langs)], text()) for i in range(n)]


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (8, 5)])
def test_equals_brute_force(spark, least, top):
    rows = [*draw(90), ("en", None), ("en", ""), (None, " . , "), ("en", "a new york city " * 300), *[("fr", "les deux mots ici")] * 9]
    assert mined(spark, rows, least=least, top=top) == brute(rows, least, top)


@pytest.mark.parametrize("partitions", ["4", "300"])
def test_common_leading_words_are_routed_deeper(spark, partitions, monkeypatch):
    """However suffixes are routed and chunks are cut, counts are the same."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(collocations, "BUCKET_ROWS", 50)
    rows = [("en", f"the one word{i % 40} other{i % 7}. the one thing alone of{i % 3}") for i in range(400)] + draw(30, 5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        given_rows = spark.createDataFrame(rows, DOCS)
        common, buckets = collocations.common_prefixes(given_rows, 1.0)
        assert buckets > 50 and len(common[2]) > 0 and len(common[3]) > 0
        spark.conf.set("spark.sql.shuffle.partitions", before)
        monkeypatch.setattr(collocations, "common_prefixes", lambda docs, rate: (common, 37))
        assert mined(spark, rows, least=5) == brute(rows, 5, 2000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_table(spark):
    assert mined(spark, []) == [] and mined(spark, [("en", None), (None, "?")]) == []


def test_very_long_text_and_repeated_rows(spark):
    rows = [("de", "ja nein doch " * 20000), *[("de", "eins zwei drei vier fünf")] * 40]
    assert mined(spark, rows) == brute(rows, 30, 2000)


def test_scores_beyond_64_bits(spark):
    a, r = 9_000_000_000_000_000_000, 9_100_000_000_000_000_000
    df = spark.createDataFrame([(a, r)], "a long, r long")
    assert df.select(collocations.exact_score(F.col("a"), F.col("r"), F.col("r"))).first()[0] == 2000000 * a // (2 * r)


@given(st.lists(st.tuples(st.lists(st.integers(1, 5), max_size=4), st.integers(1, 9)), max_size=60), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_equal_partitions_are_counts(rows, most):
    words = np.array([[*w, *[0] * (4 - len(w))] for w, _ in rows], dtype=np.int32).reshape(-1, 4)
    weight = np.array([n for _, n in rows], dtype=np.int64)
    got = {tuple(words[row, :depth].tolist()): n for row, depth, n in collocations.partitions(words, weight, np.zeros(len(rows), np.int64), most)}
    count = Counter()
    for w, n in rows:
        count.update({tuple(w[:k]): n for k in range(1, len(w) + 1)})
    assert got == {key: n for key, n in count.items() if n >= most}
