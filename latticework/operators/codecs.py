"""Per-chunk filter pipelines on binary columns.

A pipeline is a list of filters, applied first to last when writing and last to
first when reading. Reading skips an *optional* filter that fails, and those whose
bit is set in a chunk's mask; checksums are verified.
"""

from __future__ import annotations

import bz2
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Filter numbers and their names: fixed values of the file format.
FILTERS = {1: "deflate", 2: "shuffle", 3: "fletcher32", 4: "szip", 5: "nbit", 6: "scaleoffset", 307: "bzip2", 32000: "lzf"}


class FilterError(ValueError):
    """A filter that can't be applied or removed."""


@dataclass(frozen=True)
class Filter:
    name: str
    value: int = 0
    optional: bool = False


def shuffle(data: bytes, width: int) -> bytes:
    """Bytes of equal place in their element next to each other."""
    if width < 1 or len(data) % width:
        raise FilterError("data isn't a whole number of elements")
    return np.frombuffer(data, np.uint8).reshape(-1, width).T.tobytes()


def unshuffle(data: bytes, width: int) -> bytes:
    if width < 1 or len(data) % width:
        raise FilterError("data isn't a whole number of elements")
    return np.frombuffer(data, np.uint8).reshape(width, -1).T.tobytes()


def fletcher(data: bytes) -> int:
    """The checksum of fletcher32() in ``functions``, by sums over all words at once."""
    words = np.frombuffer(data + b"\0" * (len(data) % 2), "<u2").astype(np.uint64)
    n = len(words)
    first = int(words.sum()) % 65535
    second = int(((np.uint64(n) - np.arange(n, dtype=np.uint64)) % np.uint64(65535) * words % np.uint64(65535)).sum()) % 65535
    return second << 16 | first


def lzf_pack(data: bytes) -> bytes:
    """LZF: runs of up to 32 literals, and repeats of 3 to 264 bytes from up to 8192 bytes back."""
    out, seen, at, literal = bytearray(), {}, 0, 0

    def flush(end: int) -> None:
        for k in range(literal, end, 32):
            run = data[k : min(k + 32, end)]
            out.append(len(run) - 1)
            out.extend(run)

    while at < len(data):
        key = data[at : at + 3]
        back = seen.get(key) if len(key) == 3 else None
        seen[key] = at
        if back is None or at - back > 8192:
            at += 1
            continue
        n = 3
        while n < 264 and at + n < len(data) and data[back + n] == data[at + n]:
            n += 1
        flush(at)
        far = at - back - 1
        if n - 2 < 7:
            out.append((n - 2) << 5 | far >> 8)
        else:
            out += bytes([7 << 5 | far >> 8, n - 9])
        out.append(far & 255)
        at += n
        literal = at
    flush(len(data))
    return bytes(out)


def lzf_unpack(data: bytes, size: int | None = None) -> bytes:
    """The unpacked bytes, filled up with zeros to ``size``; data of that size counts as never packed."""
    if size and len(data) == size:
        return data
    out, at = bytearray(), 0
    try:
        while at < len(data):
            head = data[at]
            at += 1
            if head < 32:
                if at + head + 1 > len(data):
                    raise FilterError("cut literal")
                out += data[at : at + head + 1]
                at += head + 1
                continue
            n = head >> 5
            if n == 7:
                n += data[at]
                at += 1
            back = len(out) - ((head & 31) << 8 | data[at]) - 1
            at += 1
            if back < 0:
                raise FilterError("repeat from before the beginning")
            for k in range(back, back + n + 2):
                out.append(out[k])
    except IndexError:
        raise FilterError("cut repeat") from None
    return bytes(out).ljust(size or 0, b"\0")


def apply_filters(data: bytes, filters: list[Filter]) -> bytes:
    for f in filters:
        if f.name == "shuffle":
            data = shuffle(data, f.value)
        elif f.name == "deflate":
            data = zlib.compress(data, f.value or 6)
        elif f.name == "fletcher32":
            data = data + fletcher(data).to_bytes(4, "little")
        elif f.name == "lzf":
            data = min(data, lzf_pack(data), key=len)
        else:
            raise FilterError(f"{f.name} can't be written")
    return data


def _removed(data: bytes, f: Filter) -> bytes:
    if f.name == "shuffle":
        return unshuffle(data, f.value)
    if f.name == "deflate":
        return zlib.decompress(data)
    if f.name == "bzip2":
        return bz2.decompress(data)
    if f.name == "lzf":
        return lzf_unpack(data, f.value)
    if f.name == "fletcher32":
        if len(data) < 4 or fletcher(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise FilterError("wrong checksum")
        return data[:-4]
    raise FilterError(f"{f.name} can't be read")


def remove_filters(data: bytes, filters: list[Filter], mask: int = 0) -> bytes:
    for k in reversed(range(len(filters))):
        if mask >> k & 1:
            continue
        try:
            data = _removed(data, filters[k])
        except (FilterError, zlib.error, OSError):
            if not filters[k].optional:
                raise
    return data


def pipeline(filters: list[Filter]) -> list[Filter]:
    """The order in which filters are applied: shuffle goes first."""
    return sorted(filters, key=lambda f: f.name != "shuffle")


def encoded(data: Column, filters: list[Filter]) -> Column:
    """A binary column with the filters applied."""

    @F.arrow_udf(T.BinaryType())
    def run(batch: pa.Array) -> pa.Array:
        return pa.array([None if x is None else apply_filters(x, filters) for x in batch.to_pylist()], type=pa.binary())

    return run(data)


def decoded(data: Column, filters: list[Filter], mask: Column | None = None) -> Column:
    """A binary column with the filters removed."""

    @F.arrow_udf(T.BinaryType())
    def run(batch: pa.Array, masks: pa.Array) -> pa.Array:
        return pa.array([None if x is None else remove_filters(x, filters, m or 0) for x, m in zip(batch.to_pylist(), masks.to_pylist(), strict=True)], type=pa.binary())

    return run(data, F.lit(0) if mask is None else mask)
