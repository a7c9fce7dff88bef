"""Operators on cell tables, chunks, catalogs, codecs and workloads."""
