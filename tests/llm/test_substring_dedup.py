"""Repeated windows against a plain scan."""

import hashlib
import random

import pytest
from plain import split

from eventlake.llm import substring_dedup


def brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words, gone = split(text), set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone |= set(range(i, i + 20))
            seen.add(window)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("vocabulary", "ids"), [(2, 3), (2000, 1), (2000, 700), (50, 5)])
def test_against_brute_force(documents, vocabulary, ids):
    """Over one block of ids and over many; few words give repeats everywhere."""
    rng = random.Random(vocabulary + ids)
    text = lambda n: [f"{rng.choice('aB')}{rng.randrange(vocabulary)}é" for _ in range(n)]
    passages = [text(n) for n in (19, 20, 21, 25, 40, 120)]
    rows = []
    for i in range(50):
        words = text(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            words += p[a:] if rng.random() < 0.4 else p
            words += text(rng.randrange(3))
        rows.append((i * ids, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "x " * 3000), (-5, rows[3][1])]
    got = {row.doc_id: (row.n_words, row.n_removed, row.kept_sha256) for row in substring_dedup.repeated_spans(documents(*rows)).collect()}
    assert got == brute(rows)


def test_odd_rows(documents):
    assert substring_dedup.repeated_spans(documents()).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    got = substring_dedup.repeated_spans(documents((4, text), (4, text), (None, text), (3, text + " x"))).collect()
    assert sorted((row.doc_id or 0, row.n_removed) for row in got) == [(0, 0), (3, 30), (4, 30), (4, 30)]
    assert {tuple(map(tuple, row.removed_spans)) for row in got if row.doc_id} == {((0, 30),)}
