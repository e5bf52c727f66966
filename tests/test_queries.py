"""Every registered query against its DuckDB counterpart."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from checks.registry import QUERIES


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = entry.queries()[name](spark, small)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert compare(df, duck, sql) == []
