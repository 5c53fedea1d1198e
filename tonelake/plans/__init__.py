"""Registered queries: operators bound to the supplied tables, each with its DuckDB oracle."""
