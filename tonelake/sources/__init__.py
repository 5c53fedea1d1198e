"""Readers, record flatteners and sinks."""
