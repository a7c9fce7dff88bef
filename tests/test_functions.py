import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions import checksums, numbers, shapes, smallfloat, strings


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def decode(code, mantissa, bias):
    top, full = (1 << (7 - mantissa)) - 1, (1 << mantissa) - 1
    e, m = code >> mantissa & top, code & full
    sign = -1 if code & 128 else 1
    if e == top:
        return sign * math.inf if m == full else math.nan
    return sign * (m / (full + 1) * 2.0 ** (1 - bias) if e == 0 else (1 + m / (full + 1)) * 2.0 ** (e - bias))


@pytest.mark.parametrize("kind,mantissa,bias", [(smallfloat.E4M3, 3, 7), (smallfloat.E5M2, 2, 15)])
def test_all_codes(spark, kind, mantissa, bias):
    rows = spark.range(256).select("id", smallfloat.decode(F.col("id"), kind).alias("v")).withColumn("again", smallfloat.encode(F.col("v"), kind)).collect()
    for r in rows:
        want = decode(r.id, mantissa, bias)
        assert (math.isnan(want) and math.isnan(r.v)) or r.v == want
        if math.isfinite(want) and want:
            assert r.again == r.id


def test_small_float_edges(spark):
    values = [0.0, -0.0, math.inf, -math.inf, math.nan, 448.0, 1e9, -1e9, 2.0**-10, 2.0**-9, -(2.0**-8), 1.9999, 240.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(smallfloat.encode(F.col("v"), smallfloat.E4M3)).collect()]
    assert got == [0, 128, 127, 255, 127, 126, 127, 255, 0, 1, 130, 63, 119]


def test_exponent_is_exact_at_powers_of_two(spark):
    df = spark.createDataFrame([(k, 2.0**k) for k in range(-130, 130)], "k int, x double")
    assert df.where(smallfloat.exponent(F.col("x")) != F.col("k")).count() == 0


def test_bfloat16(spark):
    x = np.random.default_rng(3).normal(0, 1e3, 500).astype(np.float32)
    bits = x.view(np.uint32)
    want = (((bits >> 16) & 1) + 0x7FFF + bits & 0xFFFF0000).astype(np.uint32).view(np.float32)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, want, strict=True)], "x double, w double")
    assert df.where(smallfloat.bfloat16(F.col("x")) != F.col("w")).count() == 0


def test_strings(spark):
    assert one(spark, strings.null_terminated(F.lit("ab\0cd"))) == "ab"
    assert one(spark, strings.null_padded(F.lit("ab\0c\0\0"))) == "ab\0c"
    assert one(spark, strings.space_padded(F.lit("sweet  "))) == "sweet"
    assert one(spark, strings.member_padded(F.lit("a \0 \0"))) == "a"
    assert bytes(one(spark, strings.fixed_width(F.lit("é"), 1))) == b"\xc3"
    assert bytes(one(spark, strings.fixed_width(F.lit("ab"), 4))) == b"ab\0\0"


def test_paths(spark):
    for path, parent, name in [("/", "", ""), ("/a", "/", "a"), ("/a/b", "/a", "b"), ("/a/b/", "/a", "b")]:
        assert (one(spark, strings.parent_path(F.lit(path))), one(spark, strings.base_name(F.lit(path)))) == (parent, name)
    assert one(spark, strings.path_problem(F.lit("/a/b"))) is None
    for bad in ("", "a", "/", "/a//b"):
        assert one(spark, strings.path_problem(F.lit(bad)))
    assert one(spark, strings.external_file_problem(F.lit("../x"))) and not one(spark, strings.external_file_problem(F.lit("x.lw")))


def test_readable_bytes(spark):
    for n, s in [(0, "0 B"), (1023, "1023 B"), (1536, "1.5 KB"), (5 << 20, "5.0 MB"), (3 << 29, "1.50 GB")]:
        assert one(spark, strings.readable_bytes(F.lit(n).cast("long"))) == s


def test_readable_bytes_rounds_halves_to_even(spark):
    # All but the last are halves; that lies a byte above one.
    for n, s in [(1280, "1.2 KB"), (1792, "1.8 KB"), (5 << 18, "1.2 MB"), (9 << 27, "1.12 GB"), (11 << 27, "1.38 GB"), ((9 << 27) + 1, "1.13 GB")]:
        assert one(spark, strings.readable_bytes(F.lit(n).cast("long"))) == s
    assert one(spark, strings.readable_bytes(F.lit(None).cast("long"))) is None


def test_shapes(spark):
    dims = lambda *d: F.array(*[F.lit(x).cast("long") for x in d])
    assert one(spark, shapes.elements(dims(3, 4))) == 12 and one(spark, shapes.elements(F.lit(None).cast("array<bigint>"))) == 0
    assert one(spark, shapes.chunk_count(dims(25, 35), dims(10, 10))) == 12
    assert one(spark, shapes.describe(dims(2, 3, 4))) == "3D array [2 3 4]"
    assert one(spark, shapes.describe(F.array().cast("array<bigint>"))) == "scalar"
    assert one(spark, shapes.chunk_bytes(dims(1 << 40, 1 << 40), F.lit(8))) is None


def test_numbers(spark):
    assert bytes(one(spark, numbers.little_endian(F.lit(-2), 4))) == (-2).to_bytes(4, "little", signed=True)
    assert one(spark, numbers.align8(F.lit(9))) == 16
    assert numbers.spark_type("enum:uint8") == T.ShortType() and numbers.spark_type("array:float64") == T.ArrayType(T.DoubleType())
    for bad in ("enum:float64", "complex"):
        with pytest.raises(ValueError):
            numbers.spark_type(bad)


def loop_fletcher(data):
    a = b = 0
    for k in range(0, len(data), 2):
        a = (a + int.from_bytes(data[k : k + 2].ljust(2, b"\0"), "little")) % 65535
        b = (b + a) % 65535
    return b << 16 | a


def test_checksums(spark):
    data = [b"", b"a", b"ab", b"abcde", bytes(range(256)) * 5]
    rows = spark.createDataFrame([(d,) for d in data], "d binary").select("d", checksums.fletcher32(F.col("d")).alias("f"), checksums.jenkins(F.col("d")).alias("j")).collect()
    assert [r.f for r in rows] == [loop_fletcher(d) for d in data]
    assert checksums.lookup3(b"Four score and seven years ago") == 0x17770551
    assert rows[0].j == 0xDEADBEEF


def test_hashes_of_many_values_are_those_of_each():
    rng = random.Random(3)
    values = [None, b"", *[rng.randbytes(rng.randint(0, 60)) for _ in range(300)], *[rng.randbytes(n) for n in (11, 12, 13, 24, checksums.LONG, checksums.LONG + 1)]]
    assert checksums.lookup3_all(values) == [None if v is None else checksums.lookup3(v) for v in values]
    assert checksums.lookup3_all([]) == [] and checksums.lookup3_all([None]) == [None]
