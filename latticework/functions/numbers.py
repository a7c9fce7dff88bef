"""Numeric conversions, limits and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MB = 1 << 20
#: Type names of the array model and the Spark types that hold their values.
TYPES: dict[str, T.DataType] = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "vlen_string": T.StringType(),
    "opaque": T.BinaryType(),
    "object_reference": T.LongType(),
    "region_reference": T.BinaryType(),
    "vlen_uint8": T.BinaryType(),
    **{f"vlen_{k}": T.ArrayType(v) for k, v in {"int32": T.IntegerType(), "int64": T.LongType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType()}.items()},
}
#: Bytes of one element.
WIDTHS = {"int8": 1, "int16": 2, "int32": 4, "int64": 8, "uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "float32": 4, "float64": 8, "object_reference": 8, "region_reference": 12}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a type name, of ``array:<name>`` and of ``enum:<name>``."""
    head, _, base = name.partition(":")
    if head == "array":
        return T.ArrayType(spark_type(base))
    if head == "enum":
        if not base.lstrip("u").startswith("int"):
            raise ValueError(f"an enum is of integers, not {base}")
        return spark_type(base)
    if name not in TYPES:
        raise ValueError(f"unknown type {name}")
    return TYPES[name]


def to_double(v: Column) -> Column:
    return v.cast("double")


def swapped(data: Column) -> Column:
    """The bytes of a value in the other order."""
    return F.unhex(F.array_join(F.reverse(F.filter(F.split(F.regexp_replace(F.hex(data), "(..)", "$1,"), ","), lambda b: b != "")), ""))


def little_endian(v: Column, width: int) -> Column:
    """A whole number's two's complement, low byte first."""
    return swapped(F.unhex(F.substring(F.lpad(F.hex(v.cast("long")), 16, "0"), 17 - 2 * width, 2 * width)))


def align8(n: Column) -> Column:
    return (F.ceil(n / 8) * 8).cast("long")


def safe_product(a: Column, b: Column) -> Column:
    """The product, or null where it doesn't fit a BIGINT."""
    return F.try_multiply(a.cast("long"), b.cast("long"))


def _between(x: Column, lo: float, hi: float, to_lo: float, to_hi: float) -> Column:
    return F.lit(to_lo) + (x - lo) / (hi - lo) * (to_hi - to_lo)


def size_score(n: Column) -> Column:
    """A file size between 0 and 1: 100 MB is 0.3, 500 MB 0.6, 1 GB 0.8."""
    n = n.cast("double")
    score = F.when(n < 100 * MB, _between(n, 0, 100 * MB, 0.0, 0.3)).when(n < 500 * MB, _between(n, 100 * MB, 500 * MB, 0.3, 0.6)).when(n < 1024 * MB, _between(n, 500 * MB, 1024 * MB, 0.6, 0.8))
    return score.otherwise(F.least(F.lit(1.0), _between(n, 1024 * MB, 2048 * MB, 0.8, 1.0)))


def rate_score(r: Column) -> Column:
    """Operations a second between 0 and 1: 10 are 0.3, 100 are 0.7."""
    score = F.when(r < 10, _between(r, 0, 10, 0.0, 0.3)).when(r < 100, _between(r, 10, 100, 0.3, 0.7))
    return score.otherwise(F.least(F.lit(1.0), _between(r, 100, 200, 0.7, 1.0)))
