"""Queries over the synthetic tables and their DuckDB counterparts."""
