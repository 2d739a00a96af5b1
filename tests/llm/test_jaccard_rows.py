"""Sets of one key that meet as (size, bitmap)."""

import numpy as np
import pyarrow as pa
import pytest

from eventlake.llm import jaccard_join
from eventlake.llm.jaccard_join import THRESHOLD


@pytest.mark.parametrize(("tile", "rows"), [(1024, 300), (100, None)])
def test_sets_of_a_key_are_one_row_each_and_meet_all(spark, monkeypatch, tile, rows):
    monkeypatch.setattr(jaccard_join, "MARK_TILE", tile)
    n, bits = 300, bytes(jaccard_join.BITS // 8)
    shared = spark.createDataFrame([(i, 7) for i in range(n)], "doc_id long, key long")
    marked = spark.createDataFrame([(i, 20, bits) for i in range(n)], "doc_id long, n long, bits binary")
    labels = spark.createDataFrame([(i, i // 2) for i in range(n)], "doc_id long, component long")
    args = shared, marked, labels, THRESHOLD
    pairs = {(row.a, row.b) for row in jaccard_join._bounded(*args).collect()}
    assert pairs == {(a, b) for a in range(n) for b in range(a + 1, n) if a // 2 != b // 2}
    if rows:
        counted = lambda threshold: lambda table: pa.table({name: pa.array(np.array([table.num_rows])) for name in ("a", "b", "bound")})
        monkeypatch.setattr(jaccard_join, "bounded_pairs", counted)
        assert sum(row.a for row in jaccard_join._bounded(*args).collect()) == rows
