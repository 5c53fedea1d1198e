"""Joins, aggregations, windows and grouped maps over product and note tables."""
