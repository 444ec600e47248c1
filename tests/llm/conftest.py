"""Small tables for the operators' tests."""

import pytest
from awkward_rows import DOCS, ROWS


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema=DOCS):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Null, empty, very long, repeated and tied rows."""
    return frame(ROWS)


@pytest.fixture(scope="session")
def none(frame):
    return frame([])
