"""Structured Streaming jobs and the batch forms they are compared with."""
