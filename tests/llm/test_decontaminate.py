"""Contamination against every window of every item."""

import hashlib
import random
import re

import pytest
from plain import UPPER

from eventlake.llm import decontaminate

ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return ITEM.findall((text or "").translate(UPPER))


def brute(docs, items):
    out = {}
    for doc_id, text in docs:
        words, hit, found = cut(text), set(), set()
        for item_id, item in items:
            item = cut(item)
            n = min(len(item), 13)
            windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(found), ids, bool(hit) and 20 * len(hit) >= len(words))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "item", 1) for i, t in docs], "doc_id long, text string, item_id string, place int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.digest(decontaminate.contamination(d, b)).collect()
    assert len(rows) == len(docs)
    return {row.doc_id: (row.n_words, row.n_hit, row.n_items, row.items_sha256, row.contaminated) for row in rows}


@pytest.mark.parametrize("vocabulary", [3, 40, 4000])
def test_against_brute_force(spark, vocabulary):
    rng = random.Random(vocabulary)
    text = lambda n: " ".join(rng.choice(["v", "V", "é"]) + str(rng.randrange(vocabulary)) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([5, 12, 13, 14, 30, 60, 60, 1, 0])] + [(100, None)]
    docs = []
    for i in range(40):
        _, item = rng.choice(items[:7])
        part = (item or "").split()
        a = rng.randrange(max(len(part) - 12, 1))
        docs.append((i, f"{text(rng.randrange(60))}; {' '.join(part[a : a + rng.choice([12, 13, 20])])}... {text(rng.randrange(400))}"))
    docs += [(50, None), (51, ""), (52, "--"), (53, text(3000))]
    assert run(spark, docs, items) == brute(docs, items)


def test_every_long_shared_span_shares_a_fingerprint(spark):
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(13)]
    rows = [(" ".join(["a%d" % rng.randrange(99) for _ in range(rng.randrange(30))] + shared + ["b"] * rng.randrange(20)),) for _ in range(50)]
    prints = spark.createDataFrame(rows, "text string").select(decontaminate.fingerprints(decontaminate.item_words("text" if False else __import__("pyspark").sql.functions.col("text"))).alias("p"))
    sets = [{p["hash"] for p in row.p} for row in prints.collect()]
    assert set.intersection(*sets)


def test_odd_tables(spark):
    item = " ".join(f"x{i}" for i in range(20))
    assert run(spark, [], [(1, item)]) == {}
    assert run(spark, [(1, item)], []) == brute([(1, item)], [])
    d = spark.createDataFrame([(7, item), (7, item), (None, item), (None, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (1, item), (None, item)], "item_id long, text string")
    rows = decontaminate.contamination(d, b).collect()
    assert sorted((row.doc_id or 0, row.n_hit) for row in rows) == [(0, 0), (0, 20), (7, 20), (7, 20)]
