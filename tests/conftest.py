from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from checks.compare import duckdb_tables, local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SPARK = local_session()  # before the test modules, which make columns as they are read


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    return duckdb_tables(small)


@pytest.fixture
def one(spark):
    """Evaluate a column expression over rows of one text column `c`."""
    def run(column, *values, type="STRING"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, c {type}")
        return [r[0] for r in df.orderBy("i").select(column).collect()]

    return run
