import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.operators import arrays
from latticework.plans.selection import MAX_CELLS, Hyperslab, check_buffer, linear, read_slice, select


def loop(slab, dims):
    """The linear offsets of a selection by its definition, repeats included."""
    axes = [[s + k * t + b for k in range(c) for b in range(n)] for s, c, t, n in zip(slab.start, slab.count, slab.stride, slab.block, strict=True)]
    return sorted(int(np.ravel_multi_index(i, dims)) for i in itertools.product(*axes))


def ramp(spark, dims):
    names = [f"i{d}" for d in range(len(dims))]
    return arrays.grid(spark, dims, names).withColumn("v", linear(names, dims)), names


def taken(spark, slab, dims):
    cells, names = ramp(spark, dims)
    return sorted(r.v for r in select(cells, slab, names, dims).collect())


def test_one_dimension_honours_stride_and_block(spark):
    assert taken(spark, Hyperslab((1,), (2,), (10,), (3,)), (100,)) == [1, 2, 3, 11, 12, 13]


#: Published dumps of strided, blocked selections (start, count, stride, block, extents) of arrays that hold 0, 1, 2, ...
DUMPED = [
    (
        ((1,), (2,), (10,), (3,), (100,)),
        """1, 2, 3, 11, 12, 13""",
    ),
    (
        ((1, 2), (3, 2), (3, 3), (2, 2), (10, 10)),
        """12, 13, 15, 16,
        22, 23, 25, 26,
        42, 43, 45, 46,
        52, 53, 55, 56,
        72, 73, 75, 76,
        82, 83, 85, 86""",
    ),
    (
        ((0, 1, 2), (2, 2, 2), (1, 3, 3), (1, 2, 2), (2, 10, 10)),
        """12, 13, 15, 16,
        22, 23, 25, 26,
        42, 43, 45, 46,
        52, 53, 55, 56,
        112, 113, 115, 116,
        122, 123, 125, 126,
        142, 143, 145, 146,
        152, 153, 155, 156""",
    ),
    (
        ((0, 0, 1, 2), (2, 2, 3, 2), (1, 1, 3, 3), (1, 1, 2, 2), (2, 2, 10, 10)),
        """12, 13, 15, 16,
        22, 23, 25, 26,
        42, 43, 45, 46,
        52, 53, 55, 56,
        72, 73, 75, 76,
        82, 83, 85, 86,
        112, 113, 115, 116,
        122, 123, 125, 126,
        142, 143, 145, 146,
        152, 153, 155, 156,
        172, 173, 175, 176,
        182, 183, 185, 186,
        212, 213, 215, 216,
        222, 223, 225, 226,
        242, 243, 245, 246,
        252, 253, 255, 256,
        272, 273, 275, 276,
        282, 283, 285, 286,
        312, 313, 315, 316,
        322, 323, 325, 326,
        342, 343, 345, 346,
        352, 353, 355, 356,
        372, 373, 375, 376,
        382, 383, 385, 386""",
    ),
    (
        ((0, 0, 0, 0), (2, 2, 2, 2), (2, 2, 2, 2), (1, 1, 1, 1), (4, 6, 8, 10)),
        """0, 2,
        20, 22,
        160, 162,
        180, 182,
        960, 962,
        980, 982,
        1120, 1122,
        1140, 1142""",
    ),
    (
        ((0, 0, 0, 0), (2, 2, 2, 2), (1, 1, 1, 1), (1, 1, 1, 1), (4, 6, 8, 10)),
        """0, 1,
        10, 11,
        80, 81,
        90, 91,
        480, 481,
        490, 491,
        560, 561,
        570, 571""",
    ),
]


@pytest.mark.parametrize(("at", "values"), DUMPED)
def test_published_dumps(spark, at, values):
    start, count, stride, block, dims = at
    cells, names = ramp(spark, dims)
    got = select(cells, Hyperslab(start, count, stride, block), names, dims, ordinals=True)
    assert [r.v for r in got.orderBy(*[f"o{d}" for d in range(len(dims))]).collect()] == [int(v) for v in values.split(",")]


def test_two_dimensions(spark):
    got = taken(spark, Hyperslab((1, 2), (3, 2), (3, 3), (2, 2)), (10, 10))
    assert got == [10 * r + c for r in (1, 2, 4, 5, 7, 8) for c in (2, 3, 5, 6)]


def test_a_single_block_may_be_longer_than_its_stride(spark):
    got = taken(spark, Hyperslab((0,) * 4, (1,) * 4, (1,) * 4, (2,) * 4), (4, 6, 8, 10))
    assert got == [0, 1, 10, 11, 80, 81, 90, 91, 480, 481, 490, 491, 560, 561, 570, 571]


def test_overlapping_blocks_repeat_cells(spark):
    assert taken(spark, Hyperslab((0,), (2,), (1,), (3,)), (9,)) == [0, 1, 1, 2, 2, 3]


def test_random_selections_equal_their_definition(spark):
    rng = random.Random(7)
    for _ in range(12):
        dims = tuple(rng.randint(3, 9) for _ in range(rng.randint(1, 4)))
        start, count, stride, block = [], [], [], []
        for n in dims:
            s, b, t = rng.randrange(n), rng.randint(1, 3), rng.randint(1, 4)
            b = min(b, n - s)
            start, stride, block, count = start + [s], stride + [t], block + [b], count + [rng.randint(1, (n - s - b) // t + 1)]
        slab = Hyperslab(start, count, stride, block)
        assert taken(spark, slab, dims) == loop(slab, dims)
        assert len(loop(slab, dims)) == slab.size()


def test_ordinals_are_row_major(spark):
    cells, names = ramp(spark, (8, 8))
    slab = Hyperslab((1, 0), (2, 3), (4, 2), (2, 3))
    rows = select(cells, slab, names, (8, 8), ordinals=True).orderBy("o0", "o1").collect()
    want = [8 * (1 + 4 * k + b) + 2 * m + n for k in range(2) for b in range(2) for m in range(3) for n in range(3)]
    assert [r.v for r in rows] == want


@pytest.mark.parametrize(
    "slab",
    [Hyperslab((0,), (3,)), Hyperslab((5, 0), (6, 1)), Hyperslab((0, 0), (0, 1)), Hyperslab((0, 0), (1, 1), (0, 1)), Hyperslab((0, 0), (1, 1), (1, 1), (0, 1)), Hyperslab((0, 0), (3, 1), (5, 1)), Hyperslab((8, 0), (1, 1), (1, 1), (3, 1)), Hyperslab((-1, 0), (1, 1))],
)
def test_invalid_selections(slab):
    with pytest.raises(ValueError):
        slab.validate((10, 10))


def test_the_limit_counts_blocks():
    with pytest.raises(ValueError, match="at most"):
        Hyperslab((0,), (MAX_CELLS // 2 + 1,), (2,), (2,)).validate((1 << 40,))


def test_an_empty_slice_is_allowed(spark):
    cells, names = ramp(spark, (4, 4))
    assert read_slice(cells, (0, 0), (0, 4), names, (4, 4)).count() == 0
    with pytest.raises(ValueError):
        read_slice(cells, (1, 0), (4, 4), names, (4, 4))


def test_chunk_ranges_prune_partitions(spark, tmp_path):
    cells, names = ramp(spark, (20, 30))
    arrays.with_chunks(cells, {"i0": 10, "i1": 10}).write.partitionBy("chunk_i0", "chunk_i1").parquet(str(tmp_path / "t"))
    out = select(spark.read.parquet(str(tmp_path / "t")), Hyperslab((0, 12), (5, 4)), names, (20, 30), {"i0": 10, "i1": 10})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "chunk_i1" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert out.count() == 20


def test_positions(spark):
    keys = [3, 10, 11, 500, 501, 10_000, 10_001, -4]
    rows = arrays.positions(spark.createDataFrame([(k,) for k in keys], "k long"), "k", rows=2).collect()
    assert {r.k: r.i for r in rows} == {k: i for i, k in enumerate(sorted(keys))}
    assert arrays.positions(spark.createDataFrame([], "k long"), "k").count() == 0


def test_edge_chunks_round_trip(spark):
    cells, _ = ramp(spark, (25, 35))
    cut = cells.selectExpr("i0 div 10 AS k0", "i1 div 10 AS k1", "i0 % 10 AS l0", "i1 % 10 AS l1", "v")
    back = arrays.assemble(cut, ("i0", "i1"), (10, 10), (25, 35))
    assert back.where(F.col("v") == F.col("i0") * 35 + F.col("i1")).count() == 25 * 35
    assert arrays.chunk_grid(spark, (25, 35), (10, 10)).where("e0 = 5 AND e1 = 5").count() == 1


def test_resize(spark):
    cells, names = ramp(spark, (4, 4))
    assert arrays.resize(cells, names, (4, 4), (2, 3)).count() == 6
    grown = arrays.resize(cells, names, (4, 4), (5, 3), (None, 4))
    assert {(r.i0, r.i1): r.v for r in grown.collect()} == {(i, j): 4 * i + j if i < 4 else 0 for i in range(5) for j in range(3)}
    with pytest.raises(ValueError):
        arrays.resize(cells, names, (4, 4), (4, 5), (4, 4))


def test_buffers():
    assert check_buffer(5, 5) == 5
    for n in (0, 6):
        with pytest.raises(ValueError):
            check_buffer(n, 5)
