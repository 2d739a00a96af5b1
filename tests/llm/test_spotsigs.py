"""Edited texts, likeness and near pairs against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from eventlake.llm import spotsigs


def test_edited_pairs(documents):
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "der", "la", *[f"word{i}é" for i in range(200)]]
    rows = [(i * 7 - 50, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 120)))) for i in range(60)]
    rows += [(900, None), (901, ""), (902, "x"), (903, "😀é the big red dog " * 800)]
    got = {row.doc_id: row for row in spotsigs.edited_pairs(documents(*rows)).collect()}
    ordered = sorted(rows)
    prints = {}
    for (doc_id, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after, row = text or "", after or "", got[doc_id]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        assert prints.setdefault(text, row.fingerprint) == row.fingerprint
        cut = lambda p: {p[i : i + 8] for i in range(0, len(p), 8)}
        a, b = cut(row.fingerprint), cut(row.edited_fingerprint)
        assert abs(row.near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 1e-12
    assert len(got) == len(rows)


def test_odd_rows(documents):
    text = "the quick fox and the lazy dog of old"
    got = spotsigs.edited_pairs(documents((1, text), (1, text), (None, text), (2, None))).collect()
    assert len(got) == 4 and len({row.fingerprint for row in got if row.doc_id != 2}) == 1
    assert spotsigs.edited_pairs(documents()).count() == 0
    one = spotsigs.edited_pairs(documents((5, text))).first()
    assert one.near_next == 1.0


def test_near_pairs(spark):
    rng = random.Random(4)
    base = [rng.randrange(10**6) for _ in range(60)]
    sets = {i: sorted({*base[rng.randrange(3) :], *[rng.randrange(10**6) for _ in range(rng.randrange(8))]}) for i in range(30)}
    sets |= {i: sorted({rng.randrange(10**6) for _ in range(rng.randrange(1, 40))}) for i in range(30, 60)}
    sets |= {90: [], 91: [5], 92: [5, 6, 7, 8, 9], 93: [5, 6, 7, 8]}
    frame = spark.createDataFrame([(k, v) for k, v in sets.items()], "key long, hashes array<int>").withColumn("hashes", F.array_sort("hashes"))
    want = set()
    for a in sets:
        for b in sets:
            x, y = set(sets[a]), set(sets[b])
            if a < b and x and y and x != y and len(x & y) / len(x | y) >= 0.8:
                want.add((a, b))
    got = {(row.low, row.high) for row in spotsigs.near_pairs(frame, 0.8).collect()}
    assert got == want and want
