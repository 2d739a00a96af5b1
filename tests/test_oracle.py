"""Every query against its SQL counterpart on the smallest data set."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

pytest.importorskip("duckdb")
from compare import compare, connect

from __spark_entry__ import entry
from eventlake.oracle import ORACLE
from eventlake.queries import all_queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_equals_sql(spark, duck, name):
    good, message = compare(spark, duck, name, all_queries()[name], ORACLE.get(name), FOLDER)
    assert good, message


def test_every_query_has_sql():
    assert set(all_queries()) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).count() > 0
