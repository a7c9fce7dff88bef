"""Cell tables: positions, chunks, resizing and statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import key_ranges

#: Rows that are numbered together, on average, and groups of them that are summed together.
ROWS_TOGETHER, GROUPS_TOGETHER = 4096, 4096


def positions(df: DataFrame, key: str, name: str = "i", rows: int = ROWS_TOGETHER) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of a unique whole-numbered key.

    Rows are dealt to ranges of the key between its quantiles, however the keys
    are spread; the ranges' counts are summed on two levels, so no task sees all
    rows, nor one row for each range. Rows without a key have no place.
    """
    near = df.withColumn("_range", key_ranges(df, key).range_of(F.col(key), rows))
    counts = near.where("_range IS NOT NULL").groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_group", F.floor(F.col("_range") / GROUPS_TOGETHER))
    groups = counts.groupBy("_group").agg(F.sum("_rows").alias("_all"))
    # No more rows than cells of the key's ranges, or than ranges divided by GROUPS_TOGETHER.
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_group", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(inside), F.lit(0))).join(groups, "_group")
    starts = starts.select("_range", (F.col("_base") + F.col("_before")).alias("_start"))
    numbered = near.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return numbered.join(starts, "_range", "left").withColumn(name, (F.col("_start") + F.col("_n") - 1).cast("long")).drop("_range", "_n", "_start")


def matrix_cells(df: DataFrame, row: str, values: str) -> DataFrame:
    """(r, c, v) of a table with one array in each row."""
    return df.select(F.col(row).alias("r"), F.posexplode(values).alias("c", "v")).select("r", F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("v"))


def with_chunks(cells: DataFrame, chunk: dict[str, int]) -> DataFrame:
    """``cells`` with the chunk column ``chunk_<name>`` of each coordinate."""
    return cells.withColumns({f"chunk_{k}": F.floor(F.col(k) / n).cast("long") for k, n in chunk.items()})


def extent(chunk: Column, size: int, dim: int | Column) -> Column:
    """A chunk's extent in a dimension, clipped at the array's edge."""
    dim = F.lit(dim) if isinstance(dim, int) else dim
    return F.least(F.lit(size), dim - chunk * size).cast("long")


def chunk_grid(spark, dims: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """Every chunk: its row-major number, coordinates ``k0, k1, ...`` and clipped extents ``e0, e1, ...``."""
    counts = [-(-n // c) for n, c in zip(dims, chunk, strict=True)]
    out, stride = spark.range(math.prod(counts)).withColumnRenamed("id", "chunk"), math.prod(counts)
    for d, n in enumerate(counts):
        stride //= n
        out = out.withColumn(f"k{d}", F.expr(f"(chunk div {stride}) % {n}").cast("long"))
    return out.withColumns({f"e{d}": extent(F.col(f"k{d}"), c, n) for d, (n, c) in enumerate(zip(dims, chunk, strict=True))})


def touched_chunks(spark, slab, dims: Sequence[int], chunk: Sequence[int]) -> DataFrame:
    """The chunks that a selection's bounding box overlaps, row by row."""
    slab.validate(dims)
    out = None
    for d, c in enumerate(chunk):
        axis = spark.range(slab.first(d) // c, slab.last(d) // c + 1).select(F.col("id").alias(f"k{d}"))
        # Axes of a grid: the product is what is asked for, and no larger than the chunks to read.
        out = axis if out is None else out.crossJoin(axis)
    return out


def chunk_stats(cells: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """Count, least, largest, mean and population deviation of each group."""
    return cells.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_pop(value), 4).alias("sd")
    )


def grid(spark, dims: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Every coordinate of an array, from its row-major offset."""
    out, stride = spark.range(math.prod(dims)), math.prod(dims)
    for name, n in zip(names, dims, strict=True):
        stride //= n or 1
        out = out.withColumn(name, F.expr(f"(id div {stride}) % {n}").cast("long"))
    return out.drop("id")


def filled(cells: DataFrame, wanted: DataFrame, coords: Sequence[str], value: str = "v", fill: float = 0.0) -> DataFrame:
    """The wanted coordinates with their values; cells that aren't stored have the fill value."""
    return wanted.join(cells, list(coords), "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def resize(cells: DataFrame, coords: Sequence[str], old: Sequence[int], new: Sequence[int], most: Sequence[int | None] | None = None, value: str = "v") -> DataFrame:
    """An array with other extents: cells beyond them go, new ones are 0."""
    if len(new) != len(old) or min(new) < 1:
        raise ValueError("new extents must be positive, and as many as the old ones")
    if most and any(m is not None and n > m for n, m in zip(new, most, strict=True)):
        raise ValueError("new extents exceed the largest ones allowed")
    kept = cells
    for name, n, o in zip(coords, new, old, strict=True):
        if n < o:
            kept = kept.where(F.col(name) < n)
    if all(n <= o for n, o in zip(new, old, strict=True)):
        return kept
    return filled(kept, grid(cells.sparkSession, new, coords), coords, value)


def assemble(cells: DataFrame, names: Sequence[str], chunk: Sequence[int], dims: Sequence[int]) -> DataFrame:
    """Cells of chunks (``k0..``, ``l0..`` local, v) placed in the array; what lies beyond its edges goes."""
    out = cells
    for d, (name, c, n) in enumerate(zip(names, chunk, dims, strict=True)):
        out = out.withColumn(name, F.col(f"k{d}") * c + F.col(f"l{d}")).where(F.col(name) < n)
    return out
