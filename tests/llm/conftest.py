from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, source]) tuples."""

    def build(*rows):
        full = [(row[0], row[1], "en", row[2] if len(row) > 2 else "s", len(row[1]) if row[1] is not None else None) for row in rows]
        return spark.createDataFrame(full, DOC)

    return build


