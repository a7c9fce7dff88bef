"""Hierarchical array files as tables.

``objects`` and ``attributes`` list files in Spark and read the headers of each by
byte ranges in a task. ``cells`` reads one dataset of one file in parallel: the
driver looks up the chunks that a selection's bounding box touches, and puts
neighbours together up to ``CELLS_TOGETHER`` cells; a task fetches the byte ranges
of its chunks only. ``write`` makes a file: chunks
are encoded by the executors and put in order by the driver, one at a time.
"""

from __future__ import annotations

import json
import math
import os
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.numbers import TYPES
from ..operators.codecs import Filter, apply_filters, pipeline
from ..plans.selection import Hyperslab
from .h5format import Chunk, DataType, FormatError, H5File, H5Writer, type_named

FORMAT = "array_file"
#: Elements of contiguous storage in one partition.
ROWS_TOGETHER = 1 << 20
#: Cells of chunks in one partition, unless a chunk has more.
CELLS_TOGETHER = 1 << 20
OBJECTS = "file string, path string, kind string, type string, dims array<bigint>, maxdims array<bigint>, layout string, chunk array<bigint>, filters array<string>, target string"
ATTRIBUTES = "file string, path string, name string, type string, dims array<bigint>, value string"


@contextmanager
def opened(path: str) -> Iterator[H5File]:
    """A file by local path or URI, read by ranges."""
    at, name = (pafs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else pafs.FileSystem.from_uri(_uri(path))
    with at.open_input_file(name) as f:
        yield H5File(lambda offset, n: f.read_at(n, offset), f.size())


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def spark_type(kind: DataType) -> T.DataType:
    """The Spark type of a file's type."""
    if kind.kind in ("int", "float", "enum"):
        name = (kind.base or kind).name()
        return TYPES.get(name, T.FloatType())
    if kind.kind in ("string", "vlen_string"):
        return T.StringType()
    if kind.kind == "array":
        return T.ArrayType(spark_type(kind.base))
    if kind.kind == "vlen":
        return T.BinaryType() if kind.base.name() == "uint8" else T.ArrayType(spark_type(kind.base))
    if kind.kind == "compound":
        return T.StructType([T.StructField(n, spark_type(t)) for n, _, t in kind.members])
    return T.LongType() if kind.kind in ("object_reference", "bitfield") else T.BinaryType()


def _json(values) -> str:
    def plain(v):
        if isinstance(v, np.generic):
            return v.item()
        return v.hex() if isinstance(v, bytes) else str(v)

    return json.dumps(values.tolist() if isinstance(values, np.ndarray) else values, default=plain)


def _of_files(spark: SparkSession, path: str, rows, schema: str, whole: bool) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    def told(file: str, f: H5File):
        found = [(file, *r) for r in rows(f)]
        if found:
            yield pd.DataFrame(found, columns=columns, dtype=object)

    def run(batches):
        for pdf in batches:
            for k, file in enumerate(pdf["path"]):
                if whole:
                    yield from told(file, H5File.of(bytes(pdf["content"][k])))
                else:
                    with opened(file) as f:
                        yield from told(file, f)

    # Without the content Spark lists files and reads nothing of them.
    wanted = ("path", "content") if whole else ("path", "length")
    return spark.read.format("binaryFile").load(path).select(*wanted).mapInPandas(run, schema)


def describe(f: H5File) -> Iterator[tuple]:
    """The rows of ``objects`` for one file."""
    for path, kind, node in f.walk():
        if isinstance(node, str):
            yield path, kind, None, None, None, None, None, None, node
        elif kind != "dataset":
            yield path, kind, f.type_of(node).name() if kind == "datatype" else None, None, None, None, None, None, None
        else:
            dims, most = f.shape_of(node)
            s = f.storage_of(node)
            yield path, kind, f.type_of(node).name(), dims, most, s.kind, list(s.chunk) or None, [x.name for x in f.filters_of(node)], None


def objects(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Every object and link of the files at a path; ``whole`` reads them through Spark, for stores that only it opens."""
    return _of_files(spark, path, describe, OBJECTS, whole)


def attributes(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Every attribute of the files at a path; a single value isn't a list, and ``value`` is JSON."""

    def rows(f: H5File):
        for at, _, node in f.walk():
            if not isinstance(node, str):
                for name, kind, dims, values in f.attributes(node):
                    yield at, name, kind.name(), dims, _json(values[0] if len(values) == 1 else values)

    return _of_files(spark, path, rows, ATTRIBUTES, whole)


@dataclass
class Piece:
    """A box of cells: where it begins, its extents, and its chunk if it is stored as one."""

    offset: tuple[int, ...]
    shape: tuple[int, ...]
    chunk: Chunk | None
    stored: bool


@dataclass
class Pieces(InputPartition):
    """The boxes that one task reads."""

    of: list[Piece]


class CellReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.dataset = options["path"], options["dataset"]
        numbers = {k: [int(v) for v in options[k].split(",")] for k in ("start", "count", "stride", "block") if options.get(k)}
        self.slab = Hyperslab(**numbers) if numbers else None

    def partitions(self) -> list[Pieces]:
        out: list[Pieces] = []
        room = 0
        for piece in self.pieces():
            n = math.prod(piece.shape)
            if n > room:
                out.append(Pieces([]))
                room = CELLS_TOGETHER
            out[-1].of.append(piece)
            room -= n
        return out

    def pieces(self) -> list[Piece]:
        with opened(self.path) as f:
            node = f.find(self.dataset)
            dims, _ = f.shape_of(node)
            if dims is None:
                return []
            if self.slab:
                self.slab.validate(dims)
            box = [(self.slab.first(d), self.slab.last(d)) if self.slab else (0, n - 1) for d, n in enumerate(dims)]
            s = f.storage_of(node)
            if s.kind != "chunked":
                inner = max(1, math.prod(dims[1:]))
                step = max(1, ROWS_TOGETHER // inner)
                if not dims:
                    return [Piece((), (), None, True)]
                lo, hi = box[0]
                return [Piece((i, *[0] * (len(dims) - 1)), (min(step, hi + 1 - i), *dims[1:]), None, True) for i in range(lo, hi + 1, step)]
            f.chunk_cells(node)
            # Of the index only what the selection's box meets is kept.
            have = {c.offset: c for c in f.chunks_of(node) if all(o <= hi and o + k > lo for o, k, (lo, hi) in zip(c.offset, s.chunk, box, strict=True))}
            axes = [range(lo // k, hi // k + 1) for (lo, hi), k in zip(box, s.chunk, strict=True)]
            out = []
            for at in np.ndindex(*[len(a) for a in axes]):
                offset = tuple(int(a[i]) * k for a, i, k in zip(axes, at, s.chunk, strict=True))
                shape = tuple(min(k, n - o) for k, n, o in zip(s.chunk, dims, offset, strict=True))
                out.append(Piece(offset, shape, have.get(offset), False))
            return out

    def _picked(self, piece: Piece) -> list[np.ndarray]:
        """The selected coordinates of each dimension that lie in the piece, repeats included."""
        out = []
        for d, (o, n) in enumerate(zip(piece.offset, piece.shape, strict=True)):
            if self.slab is None:
                out.append(np.arange(o, o + n))
                continue
            s, c, t, b = (getattr(self.slab, k)[d] for k in ("start", "count", "stride", "block"))
            # Only the blocks that reach into the piece are spelled out.
            lo, hi = max(0, -(-(o - b + 1 - s) // t)), min(c - 1, (o + n - 1 - s) // t)
            at = (s + np.arange(lo, hi + 1)[:, None] * t + np.arange(b)[None, :]).reshape(-1)
            out.append(at[(at >= o) & (at < o + n)])
        return out

    def read(self, pieces: Pieces | None):
        if pieces is None:  # there are no partitions
            return
        with opened(self.path) as f:
            node = f.find(self.dataset)
            for piece in pieces.of:
                yield from self._read(f, node, piece)

    def _read(self, f: H5File, node, piece: Piece):
        kind = f.type_of(node)
        if piece.stored:
            dims, _ = f.shape_of(node)
            first = piece.offset[0] * math.prod(dims[1:]) if dims else 0
            values = f.decode(f.raw(node, first, math.prod(piece.shape)), kind, math.prod(piece.shape))
            shape = piece.shape
        elif piece.chunk is None:
            shape = piece.shape
            n = math.prod(shape)
            values = f.decode(bytes(n * kind.size), kind, n)
        else:
            values, shape = f.chunk_values(node, piece.chunk), f.storage_of(node).chunk
        picked = self._picked(piece)
        if not all(len(p) for p in picked):
            return
        local = np.ix_(*[p - o for p, o in zip(picked, piece.offset, strict=True)]) if picked else ()
        where = np.arange(math.prod(shape)).reshape(shape)[local].reshape(-1)
        coords = [g.reshape(-1) for g in np.meshgrid(*picked, indexing="ij")] if picked else []
        wanted = values[where].astype(values.dtype.newbyteorder("=")) if isinstance(values, np.ndarray) else [values[i] for i in where]
        to = to_arrow(spark_type(kind))
        column = _column(wanted, to)
        yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in coords], column], names=[*[f"i{d}" for d in range(len(coords))], "v"])


def _column(values, to: pa.DataType) -> pa.Array:
    if isinstance(values, np.ndarray):
        if pa.types.is_decimal(to):
            from decimal import Decimal

            return pa.array([Decimal(int(v)) for v in values], to)
        return pa.array(values.astype(np.float32) if values.dtype == np.float16 else values).cast(to)
    return pa.array(values, to)


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


class ArrayFileSource(DataSource):
    """Cells of a dataset: options ``path``, ``dataset``, and ``start``, ``count``, ``stride``, ``block`` as numbers with commas."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        with opened(self.options["path"]) as f:
            node = f.find(self.options["dataset"])
            if node.kind != "dataset":
                raise FormatError(f"{self.options['dataset']} is no dataset")
            dims, _ = f.shape_of(node)
            return T.StructType([*[T.StructField(f"i{d}", T.LongType()) for d in range(len(dims or []))], T.StructField("v", spark_type(f.type_of(node)))])

    def reader(self, schema) -> CellReader:
        return CellReader(dict(self.options))


def cells(spark: SparkSession, path: str, dataset: str, slab: Hyperslab | None = None) -> DataFrame:
    """The cells (i0, i1, ..., v) of a dataset, or those of a selection."""
    spark.dataSource.register(ArrayFileSource)
    reader = spark.read.format(FORMAT).option("path", path).option("dataset", dataset)
    for name in ("start", "count", "stride", "block") if slab else ():
        reader = reader.option(name, ",".join(map(str, getattr(slab, name))))
    return reader.load()


@contextmanager
def created(path: str) -> Iterator[H5Writer]:
    """A writer for a new file; it appears at its place, a local path or URI, when it is whole."""
    with tempfile.TemporaryDirectory() as folder:
        name = f"{folder}/file"
        with open(name, "wb") as f:

            def patch(at: int, data: bytes) -> None:
                f.seek(at)
                f.write(data)
                f.seek(0, os.SEEK_END)

            writer = H5Writer(f.write, patch)
            yield writer
            writer.close()
        to, at = (pafs.LocalFileSystem(), path) if "://" not in path and not path.startswith("file:") else pafs.FileSystem.from_uri(_uri(path))
        to.create_dir(at.rpartition("/")[0])
        pafs.copy_files(name, at, source_filesystem=pafs.LocalFileSystem(), destination_filesystem=to)


def encoded_chunks(df: DataFrame, dtype: str, chunk: Sequence[int], filters: Sequence[Filter], coords: Sequence[str], value: str) -> DataFrame:
    """(k0, k1, ..., data): each chunk's bytes with the filters applied; cells that aren't there are 0."""
    kind, names, chunk, filters = type_named(dtype), [f"k{d}" for d in range(len(chunk))], tuple(chunk), list(filters)
    rows = df.select(*[F.floor(F.col(c) / n).cast("long").alias(k) for c, n, k in zip(coords, chunk, names, strict=True)], *[F.pmod(F.col(c), F.lit(n)).cast("long").alias(f"l{d}") for d, (c, n) in enumerate(zip(coords, chunk, strict=True))], F.col(value).alias("v"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(chunk, kind.numpy)
        block[tuple(pdf[f"l{d}"].to_numpy() for d in range(len(chunk)))] = pdf["v"].to_numpy()
        return pdf[names].head(1).assign(data=[apply_filters(block.tobytes(), filters)])

    return rows.groupBy(*names).applyInPandas(pack, ", ".join(f"{k} bigint" for k in names) + ", data binary")


def write_cells(writer: H5Writer, path: str, df: DataFrame, dtype: str, dims: Sequence[int], chunk: Sequence[int], coords: Sequence[str], value: str = "v", filters: Sequence[Filter] = (), most: Sequence[int | None] | None = None) -> None:
    """A cell table as a chunked dataset."""
    filters = pipeline(list(filters))
    rows = encoded_chunks(df, dtype, chunk, filters, coords, value).orderBy(*[f"k{d}" for d in range(len(chunk))])
    parts = ((tuple(r[d] * c for d, c in enumerate(chunk)), bytes(r["data"])) for r in rows.toLocalIterator())
    writer.chunked(path, type_named(dtype), dims, chunk, parts, filters, most, ready=True)
