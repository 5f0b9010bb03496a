from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from panel360 import local_session

    session = local_session("panel360-tests", 8, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def panel(spark):
    from panel360.plans import bindings

    return bindings.panel(spark, SF)


@pytest.fixture
def make(spark):
    """A table from a schema and rows of column values, the rest NULL."""
    def table(schema, *rows):
        data = [tuple(row.get(f.name) for f in schema.fields) for row in rows]
        return spark.createDataFrame(data, schema)
    return table
