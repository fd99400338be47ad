from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dealweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate a column over literal rows: values(rows, schema, column) -> list."""

    def run(rows, schema, *columns):
        got = spark.createDataFrame(rows, schema).select(*columns).collect()
        return [r[0] if len(columns) == 1 else tuple(r) for r in got]

    return run
