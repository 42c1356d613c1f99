"""Composite queries and their DuckDB counterparts."""
