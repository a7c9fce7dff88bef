"""Rectangular, strided and blocked selections of N-dimensional arrays.

An array is a *cell table*: one BIGINT column for each dimension and a value. A
selection takes, in each dimension, the offsets ``start + k * stride + b`` for
``k < count`` and ``b < block``. It is checked here, on the driver; what reaches
Spark are plain predicates on the coordinates, to which ranges on chunk columns
are added so that partitions are pruned. Only where blocks overlap does a small
relation of coordinates take part in a join, as cells then repeat.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most cells that a selection may have.
MAX_CELLS = 1_000_000_000
#: The most bytes of a chunk, an attribute and a string.
MAX_CHUNK_BYTES, MAX_ATTRIBUTE_BYTES, MAX_STRING_BYTES = 1 << 30, 64 << 20, 16 << 20


@dataclass(frozen=True)
class Hyperslab:
    """A selection; stride and block are 1 in every dimension if left out."""

    start: Sequence[int]
    count: Sequence[int]
    stride: Sequence[int] | None = None
    block: Sequence[int] | None = None
    rank: int = field(init=False)

    def __post_init__(self):
        ones = (1,) * len(self.start)
        object.__setattr__(self, "rank", len(self.start))
        for name in ("start", "count", "stride", "block"):
            value = getattr(self, name)
            object.__setattr__(self, name, ones if value is None else tuple(int(v) for v in value))

    def validate(self, dims: Sequence[int]) -> Hyperslab:
        """Raises ValueError unless the selection fits an array of these extents."""
        for name in ("start", "count", "stride", "block"):
            if len(getattr(self, name)) != len(dims):
                raise ValueError(f"{name} has {len(getattr(self, name))} dimensions, the array has {len(dims)}")
        for d, n in enumerate(dims):
            s, c, t, b = self.start[d], self.count[d], self.stride[d], self.block[d]
            if c < 1 or t < 1 or b < 1:
                raise ValueError(f"count, stride and block must be positive in dimension {d}")
            if s < 0 or s + (c - 1) * t + b > n:
                raise ValueError(f"selection ends at {s + (c - 1) * t + b} in dimension {d}, the array at {n}")
        if self.size() > MAX_CELLS:
            raise ValueError(f"selection of {self.size()} cells, at most {MAX_CELLS} are allowed")
        return self

    def size(self) -> int:
        return prod(c * b for c, b in zip(self.count, self.block, strict=True))

    def first(self, d: int) -> int:
        return self.start[d]

    def last(self, d: int) -> int:
        return self.start[d] + (self.count[d] - 1) * self.stride[d] + self.block[d] - 1

    def overlaps(self, d: int) -> bool:
        """Whether blocks of a dimension share offsets, so that cells repeat."""
        return self.count[d] > 1 and self.block[d] > self.stride[d]

    def predicate(self, d: int, i: Column) -> Column:
        """Whether a coordinate is selected, in a dimension whose blocks don't overlap."""
        s, c, t, b = self.start[d], self.count[d], self.stride[d], self.block[d]
        span = i.between(s, self.last(d))
        # A single block, and blocks that touch, are plain ranges.
        return span if c == 1 or b == t else span & (F.pmod(i - s, F.lit(t)) < b)

    def ordinal(self, d: int, i: Column) -> Column:
        """The place of a selected coordinate among those of its dimension."""
        s, t, b = self.start[d], self.stride[d], self.block[d]
        if self.count[d] == 1 or b == t:
            return i - s
        return F.floor((i - s) / t) * b + F.pmod(i - s, F.lit(t))


def selection_problem(start: Column, count: Column, stride: Column, block: Column, dims: Column) -> Column:
    """What is wrong with the selection of each row, given as arrays; null if nothing. The rules are those of Hyperslab.validate()."""
    rank = F.size(dims)
    axes = F.arrays_zip(start.alias("s"), count.alias("c"), stride.alias("t"), block.alias("b"), dims.alias("n"))
    ranks = F.lit(False)
    for part in (start, count, stride, block):
        ranks = ranks | (F.size(part) != rank)
    cells = F.aggregate(axes, F.lit(1.0), lambda total, x: total * x["c"] * x["b"])
    return (
        F.when(ranks, "rank differs")
        .when(F.exists(axes, lambda x: F.least(x["c"], x["t"], x["b"]) < 1), "count, stride and block must be positive")
        .when(F.exists(axes, lambda x: (x["s"] < 0) | (x["s"] + (x["c"] - 1) * x["t"] + x["b"] > x["n"])), "selection leaves the array")
        .when(cells > MAX_CELLS, "too many cells")
    )


def slice_of(start: Sequence[int], count: Sequence[int]) -> Hyperslab:
    """The contiguous box ``[start, start + count)``; a count of 0 selects nothing."""
    return Hyperslab(start, count)


def validate_slice(slab: Hyperslab, dims: Sequence[int]) -> None:
    """Like Hyperslab.validate(), but a slice may be empty."""
    if len(slab.start) != len(dims) or len(slab.count) != len(dims):
        raise ValueError("rank of the slice and the array differ")
    for d, n in enumerate(dims):
        if slab.start[d] < 0 or slab.count[d] < 0 or slab.start[d] + slab.count[d] > n:
            raise ValueError(f"slice leaves dimension {d}")


def coordinates(spark, slab: Hyperslab, d: int, name: str, ordinal: str) -> DataFrame:
    """One dimension's selected coordinates with their ordinals, repeats included."""
    k = spark.range(slab.count[d]).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(slab.block[d] - 1))).alias("b"))
    return k.select((slab.start[d] + F.col("k") * slab.stride[d] + F.col("b")).alias(name), (F.col("k") * slab.block[d] + F.col("b")).alias(ordinal))


def select(cells: DataFrame, slab: Hyperslab, coords: Sequence[str], dims: Sequence[int], chunks: dict[str, int] | None = None, ordinals: bool = False) -> DataFrame:
    """The selected cells; with ``ordinals`` also ``o0, o1, ...``, their places in row-major order.

    ``chunks`` maps a coordinate to its chunk extent where ``cells`` has the chunk
    column ``chunk_<coordinate>``: a range on that prunes partitions.
    """
    slab.validate(dims)
    out = cells
    for d, name in enumerate(coords):
        if chunks and name in chunks:
            out = out.where(F.col(f"chunk_{name}").between(slab.first(d) // chunks[name], slab.last(d) // chunks[name]))
        if not slab.overlaps(d):
            out = out.where(slab.predicate(d, F.col(name)))
            if ordinals:
                out = out.withColumn(f"o{d}", slab.ordinal(d, F.col(name)).cast("long"))
        else:
            out = out.where(F.col(name).between(slab.first(d), slab.last(d)))
            met = coordinates(cells.sparkSession, slab, d, name, f"o{d}")
            out = out.join(met, name)
            out = out if ordinals else out.drop(f"o{d}")
    return out


def read_slice(cells: DataFrame, start: Sequence[int], count: Sequence[int], coords: Sequence[str], dims: Sequence[int]) -> DataFrame:
    slab = slice_of(start, count)
    validate_slice(slab, dims)
    return cells.where(F.lit(False)) if 0 in slab.count else select(cells, slab, coords, dims)


def linear(coords: Sequence[str], dims: Sequence[int]) -> Column:
    """The row-major offset of a cell."""
    out = F.lit(0).cast("long")
    for name, n in zip(coords, dims, strict=True):
        out = out * n + F.col(name)
    return out


def check_buffer(size: int, most: int, what: str = "buffer") -> int:
    """A size that must be positive and within a limit."""
    if not 0 < size <= most:
        raise ValueError(f"{what} of {size} bytes, at most {most} are allowed")
    return size
