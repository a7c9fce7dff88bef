"""Containers as Parquet tables, text dumps, and raw bytes."""
