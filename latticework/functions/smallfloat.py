"""Floats of 8 and 16 bits as expressions on doubles and bytes.

``encode`` gives the code as an INT, ``decode`` the value as a DOUBLE. The rules
for the 8-bit formats are those that the files rely on, whatever standard they
follow: mantissas round half away from zero and don't carry into the exponent,
the code of infinity also stands for NaN when encoding, and in the largest
exponent only the full mantissa is infinite.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Small:
    """A format of 8 bits: mantissa bits, exponent bias, and the least exponent that isn't flushed to 0."""

    mantissa: int
    bias: int
    least: int

    @property
    def top(self) -> int:
        return (1 << (7 - self.mantissa)) - 1

    @property
    def full(self) -> int:
        return (1 << self.mantissa) - 1


E4M3, E5M2 = Small(3, 7, -9), Small(2, 15, -17)
_INF, _NAN = float("inf"), float("nan")


def exponent(x: Column) -> Column:
    """The largest whole e with 2^e <= x, for positive x; log2 alone is off by one at some powers of two."""
    e = F.floor(F.log2(x))
    return (e + F.when(x >= F.pow(F.lit(2.0), e + 1), 1).when(x < F.pow(F.lit(2.0), e), -1).otherwise(0)).cast("int")


def encode(x: Column, kind: Small) -> Column:
    """The code of a value; null for null."""
    sign = F.when(x < 0, 128).otherwise(0)
    a, parts = F.abs(x), 1 << kind.mantissa
    e = exponent(a)
    low = 1 - kind.bias
    sub = F.least(F.floor(a / F.pow(F.lit(2.0), F.lit(low)) * parts + 0.5), F.lit(kind.full))
    fraction = F.least(F.floor((a / F.pow(F.lit(2.0), e) - 1) * parts + 0.5), F.lit(kind.full))
    size = F.when(e < kind.least, 0).when(e < low, sub).otherwise((e + kind.bias) * parts + fraction)
    return (
        F.when(F.isnan(x), 127)
        .when(a == _INF, sign + 127)
        .when(x == 0, F.when(x.cast("string") == "-0.0", 128).otherwise(0))
        .when(e > kind.top - kind.bias, sign + 127)
        .otherwise(sign + size)
        .cast("int")
    )


def decode(code: Column, kind: Small) -> Column:
    """The value of a code between 0 and 255."""
    e = F.shiftright(code, kind.mantissa).bitwiseAND(F.lit(kind.top))
    m = code.bitwiseAND(F.lit(kind.full)).cast("double") / (1 << kind.mantissa)
    size = F.when(e == 0, m * 2.0 ** (1 - kind.bias)).otherwise((1 + m) * F.pow(F.lit(2.0), (e - kind.bias).cast("double")))
    size = F.when(e == kind.top, F.when(m == kind.full / (1 << kind.mantissa), F.lit(_INF)).otherwise(F.lit(_NAN))).otherwise(size)
    return F.when((code >= 128) & (size != 0), -size).otherwise(size)


def bfloat16(x: Column) -> Column:
    """The nearest 16-bit float of a normal value, halves to even, as a double; zeros and non-finite values stay."""
    a = F.abs(x)
    unit = F.pow(F.lit(2.0), (exponent(a) - 7).cast("double"))
    return F.when((x == 0) | F.isnan(x) | (a == _INF), x).otherwise(F.rint(x / unit) * unit)
