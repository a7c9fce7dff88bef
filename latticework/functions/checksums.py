"""Checksums of stored bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fletcher32(data: Column) -> Column:
    """Fletcher's checksum over 16-bit words, low byte first; an odd last byte counts as a word.

    Both sums have a closed form, so nothing is carried from word to word.
    """
    zero = F.lit(0).cast("long")

    def sums(even: Column) -> Column:
        n = F.floor(F.octet_length(even) / 2).cast("long")

        def word(k: Column) -> Column:
            # Two bytes where they lie: no more than these is copied.
            high_first = F.conv(F.hex(F.substring(even, (k * 2 + 1).cast("int"), F.lit(2))), 16, 10).cast("long")
            return F.struct(k.alias("k"), (F.pmod(high_first, F.lit(256)) * 256 + F.shiftright(high_first, 8)).alias("w"))

        words = F.transform(F.sequence(zero, F.greatest(n, F.lit(1)) - 1), word)
        both = F.struct(zero.alias("a"), zero.alias("b"))
        total = F.aggregate(words, both, lambda s, x: F.struct(((s["a"] + x["w"]) % 65535).alias("a"), ((s["b"] + (n - x["k"]) % 65535 * x["w"]) % 65535).alias("b")))
        return F.when(n == 0, zero).otherwise(total["b"] * 65536 + total["a"])

    even = F.when(F.octet_length(data) % 2 == 1, F.concat(data, F.lit(b"\0"))).otherwise(data)
    # As a lambda's variable the bytes are made once, and not again for each word.
    return F.transform(F.array(even), sums)[0].cast("long")


_MASK = 0xFFFFFFFF


def _rot(x: int, k: int) -> int:
    return ((x << k) | (x >> (32 - k))) & _MASK


def lookup3(data: bytes, seed: int = 0) -> int:
    """Bob Jenkins' lookup3 hash of bytes, as metadata and names use it."""
    a = b = c = (0xDEADBEEF + len(data) + seed) & _MASK
    at = 0
    while len(data) - at > 12:
        x, y, z = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (0, 4, 8))
        a, b, c = (a + x) & _MASK, (b + y) & _MASK, (c + z) & _MASK
        for turn in (4, 6, 8, 16, 19, 4):
            # Each step mixes the three and passes their roles on.
            a = ((a - c) & _MASK) ^ _rot(c, turn)
            c = (c + b) & _MASK
            a, b, c = b, c, a
        at += 12
    tail = data[at:]
    if not tail:
        return c
    tail = tail.ljust(12, b"\0")
    x, y, z = (int.from_bytes(tail[k : k + 4], "little") for k in (0, 4, 8))
    a, b, c = (a + x) & _MASK, (b + y) & _MASK, (c + z) & _MASK
    for turn in (14, 11, 25, 16, 4, 14, 24):
        c = ((c ^ b) - _rot(b, turn)) & _MASK
        a, b, c = b, c, a
    # Seven steps have passed the roles on seven times: the last one changed is now b.
    return b


#: Bytes beyond which a value is hashed by itself: rows that long are too few to share numpy's steps.
LONG = 1 << 10


def lookup3_all(values: list[bytes | None]) -> list[int | None]:
    """lookup3() of each value, null for null; a step is taken for all values of up to LONG bytes together."""
    out: list[int | None] = [None if x is None else lookup3(x) if not x or len(x) > LONG else 0 for x in values]
    # Those of most blocks first, so that the values a step concerns are the first ones.
    at = sorted((i for i, x in enumerate(values) if x and len(x) <= LONG), key=lambda i: -len(values[i]))
    if not at:
        return out
    sizes = np.array([len(values[i]) for i in at])
    blocks = (sizes + 11) // 12
    words = np.frombuffer(b"".join(values[i].ljust(12 * int(n), b"\0") for i, n in zip(at, blocks, strict=True)), dtype="<u4")
    first = 3 * (np.cumsum(blocks) - blocks)
    mixed = np.repeat((np.uint32(0xDEADBEEF) + sizes.astype(np.uint32))[None, :], 3, axis=0)

    def rot(x: np.ndarray, k: int) -> np.ndarray:
        return (x << np.uint32(k)) | (x >> np.uint32(32 - k))

    for block in range(int(blocks[0]) - 1):
        m = int(np.count_nonzero(blocks - 1 > block))
        a, b, c = (mixed[k, :m] + words[first[:m] + 3 * block + k] for k in range(3))
        for turn in (4, 6, 8, 16, 19, 4):
            a, b, c = b, c + b, (a - c) ^ rot(c, turn)
        mixed[:, :m] = a, b, c
    a, b, c = (mixed[k] + words[first + 3 * (blocks - 1) + k] for k in range(3))
    for turn in (14, 11, 25, 16, 4, 14, 24):
        a, b, c = b, (c ^ b) - rot(b, turn), a
    for i, h in zip(at, b.tolist(), strict=True):
        out[i] = h
    return out


@F.arrow_udf(T.LongType())
def _lookup3(data: pa.Array) -> pa.Array:
    return pa.array(lookup3_all(data.to_pylist()), type=pa.int64())


def jenkins(data: Column) -> Column:
    """lookup3() of a binary column."""
    return _lookup3(data)
