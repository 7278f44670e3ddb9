import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edges import ROWS, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([(d, t, x, "s", None, "t", "w", 1, 2, "o", 3, 4) for d, t, x in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
