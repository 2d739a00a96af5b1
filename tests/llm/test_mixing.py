"""Targets, shares and repeats of the mix."""

import pytest

from eventlake.llm import mixing
from plain import words


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    rest = total
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in full}
        rest -= sum(3 * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_and_taken(documents):
    sizes = {"a": 40, "b": 9000, "c": 3000, "d": 700, None: 5000}
    rows, n = [], 0
    for source, size in sizes.items():
        while size:
            take = min(size, 1 + (n * 37) % 211)
            rows.append((n, words(take), source))
            size, n = size - take, n + 1
    got = mixing.mix(documents(*rows), block_words=8, shard_slots=64).collect()
    want = plain_targets(sizes)
    source_of = {row[0]: row[2] for row in rows}
    for source in sizes:
        mine = [row for row in got if source_of[row.doc_id] == source]
        assert {row.source_size for row in mine} == {sizes[source]}
        assert all(row.target == pytest.approx(want[source]) for row in mine)
        assert sum(row.taken for row in mine) == pytest.approx(want[source], rel=0.08)
    assert all(row.taken <= 3 * row.size for row in got) and len(got) == len(rows)
    again = mixing.mix(documents(*rows[::-1]), block_words=8, shard_slots=64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_a_pass_takes_every_block_once(spark, documents):
    targets = mixing.source_targets(spark.createDataFrame([("a", 1000), ("b", 3000)], "source string, size long"))
    slots = mixing.mixed_blocks(targets, 16, 32, 1).collect()
    blocks = {"a": 63, "b": 188}
    for source, n in blocks.items():
        taken = [row.block for row in sorted(slots, key=lambda r: r.slot) if row.source == source]
        assert len(set(taken[:n])) == min(n, len(taken)) and all(0 <= b < n for b in taken)


def test_odd_rows(documents):
    got = mixing.mix(documents((1, None), (2, ""), (3, " \t "), (None, "x y"), (4, "a b c"), (4, "a b c"), (5, words(20000)))).collect()
    assert sorted((row.doc_id is None, row.doc_id or 0, row.size) for row in got) == [(False, 1, 0), (False, 2, 0), (False, 3, 0), (False, 4, 3), (False, 4, 3), (False, 5, 20000), (True, 0, 2)]
    assert all(row.taken <= 3 * row.size for row in got)


def test_empty(documents):
    assert mixing.mix(documents()).count() == 0
    assert [row.taken for row in mixing.mix(documents((1, ""))).collect()] == [0]
