"""Registered queries and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.bindings import duckdb_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = (), ctes: str = ""
          ) -> Callable[[Query], Query]:
    """Register a query. `sql` may use the bindings in `needs` and its own `ctes`."""
    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            parts = [p for p in (duckdb_ctes(*needs), ctes.strip()) if p]
            ORACLES[name] = (f"WITH {', '.join(parts)}\n" if parts else "") + sql.strip()
        return fn

    return register
