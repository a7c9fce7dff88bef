"""Shapes as arrays of extents; null stands for an unlimited one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elements(dims: Column) -> Column:
    """The number of cells; an array without dimensions has one, a null array none."""
    return F.coalesce(F.aggregate(dims, F.lit(1).cast("long"), lambda n, d: n * d), F.lit(0).cast("long"))


def chunk_count(dims: Column, chunk: Column) -> Column:
    """How many chunks cover the shape."""
    per = F.zip_with(dims, chunk, lambda n, c: F.ceil(n / c).cast("long"))
    return F.aggregate(per, F.lit(1).cast("long"), lambda n, d: n * d)


def chunk_bytes(chunk: Column, element: Column) -> Column:
    """The bytes of a full chunk, or null where they don't fit a BIGINT."""
    return F.aggregate(chunk, element.cast("long"), lambda n, d: F.try_multiply(n, d.cast("long")))


def describe(dims: Column) -> Column:
    """``scalar``, ``null``, ``1D array [n]``, ``2D array [r x c]`` or ``kD array [a b ...]``."""
    text = F.transform(dims, lambda d: d.cast("string"))
    n = F.size(dims)
    return (
        F.when(dims.isNull(), "null")
        .when(n == 0, "scalar")
        .when(n == 1, F.concat(F.lit("1D array ["), text[0], F.lit("]")))
        .when(n == 2, F.concat(F.lit("2D array ["), text[0], F.lit(" x "), F.get(text, F.lit(1)), F.lit("]")))
        .otherwise(F.concat(n.cast("string"), F.lit("D array ["), F.array_join(text, " "), F.lit("]")))
    )


def fits(dims: Column, most: Column) -> Column:
    """Whether extents stay within their maxima; null is unlimited."""
    return (F.size(dims) == F.size(most)) & F.forall(F.zip_with(dims, most, lambda d, m: m.isNull() | (d <= m)), lambda ok: ok)


def chunk_valid(dims: Column, chunk: Column) -> Column:
    """Whether a chunk has the array's rank and 1 to extent cells in each dimension."""
    return (F.size(dims) == F.size(chunk)) & F.forall(F.zip_with(dims, chunk, lambda d, c: (c > 0) & (c <= d)), lambda ok: ok)


def chunk_of_index(index: Column, counts: list[int]) -> list[Column]:
    """The coordinates of a chunk from its row-major number."""
    out, stride = [], 1
    for n in reversed(counts):
        out.insert(0, F.pmod(F.floor(index / stride), F.lit(n)).cast("long"))
        stride *= n
    return out
