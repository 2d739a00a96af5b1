from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from eventlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression without input."""

    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]

    return value
