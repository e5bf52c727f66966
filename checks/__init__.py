"""Test-table inputs, registered queries and their DuckDB counterparts."""
