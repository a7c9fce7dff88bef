"""Structured Streaming forms of the workload operators."""
