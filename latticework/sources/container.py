"""A container: a folder of Parquet tables, one for each dataset, and its catalog.

``create`` makes one, ``add_*`` and ``write_*`` change it, ``load`` reads it. Each
change writes the catalog tables that it changes to new folders, and a version that
names the folders of all three last, so readers see the old catalog or the new one,
whole; data are written and checked before the catalog knows of them.

A dataset's cells are all there: the extents' product, each place once. Resized
datasets keep the extents that are still ``stored``: cells beyond these were
dropped, or never written, and are read as 0, or as empty texts.

Paths may lead through links: hard links and soft ones, in chains, and external
ones into containers beside this one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.numbers import spark_type
from ..functions.shapes import describe
from ..functions.strings import external_file_problem, path_problem
from ..operators import arrays, catalog
from ..operators.iterate import ChunkIterator
from ..plans.selection import Hyperslab, select

OBJECTS = "path string, parent string, name string, kind string, object_id bigint, dtype string, dims array<bigint>, maxdims array<bigint>, chunk array<bigint>, stored array<bigint>, folder string"
LINKS = "path string, kind string, target_path string, target_file string"
ATTRIBUTES = "path string, name string, dtype string, value string"
SCHEMAS = {"objects": OBJECTS, "links": LINKS, "attributes": ATTRIBUTES}
VERSIONS = "version int, format int, writer string, objects string, links string, attributes string"
#: Links that a path may lead through.
MAX_HOPS = 32


def _given(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the driver has, handed over as an Arrow table: plain rows would pass through Python workers."""
    fields = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields))


class Container:
    """An open container."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        found = self._versions().agg(F.max_by(F.struct("version", "format", "objects", "links", "attributes"), F.col("version"))).first()[0]
        if found is None:
            raise FileNotFoundError(f"no container at {path}")
        self.version, self.format_version = found.version, found.format
        self.folders = {name: found[name] for name in SCHEMAS}

    def _versions(self) -> DataFrame:
        return self.spark.read.json(f"{self.path}/versions", schema=VERSIONS)

    @classmethod
    def create(cls, spark: SparkSession, path: str, mode: str = "errorifexists", format_version: int = 2) -> Container:
        """A new container with its root group; mode ``overwrite`` replaces one."""
        if format_version not in (0, 2, 3):
            raise ValueError("format version must be 0, 2 or 3")
        path = path.rstrip("/")
        root = {"objects": [("/", "", "", "group", 0, None, None, None, None, None, None)], "links": [], "attributes": []}
        for name, rows in root.items():
            _given(spark, rows, SCHEMAS[name]).coalesce(1).write.mode(mode).parquet(f"{path}/catalog/first/{name}")
        first = [(0, format_version, "first", *[f"first/{name}" for name in SCHEMAS])]
        _given(spark, first, VERSIONS).coalesce(1).write.mode(mode).json(f"{path}/versions")
        return cls(spark, path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/catalog/{self.folders[name]}")

    @property
    def objects(self) -> DataFrame:
        return self._table("objects")

    @property
    def links(self) -> DataFrame:
        return self._table("links")

    @property
    def attributes(self) -> DataFrame:
        return self._table("attributes")

    def _commit(self, **changed: DataFrame) -> None:
        to, writer = self.version + 1, uuid.uuid4().hex
        folders = dict(self.folders)
        for name, rows in changed.items():
            folders[name] = f"{writer}/{name}"
            rows.coalesce(1).write.parquet(f"{self.path}/catalog/{folders[name]}")
        _given(self.spark, [(to, self.format_version, writer, *folders.values())], VERSIONS).coalesce(1).write.mode("append").json(f"{self.path}/versions")
        others = self._versions().where((F.col("version") == to) & (F.col("writer") != writer)).count()
        if others:
            raise RuntimeError("another writer has changed the container at the same time: open it again")
        self.version, self.folders = to, folders

    def _found(self, path: str):
        return self.objects.where(F.col("path") == path).first()

    def open(self, path: str) -> tuple[Container, Row]:
        """The object that a path leads to, through links if need be, and the container it lies in."""
        box = self
        for _ in range(MAX_HOPS):
            row = box._found(path)
            if row is not None:
                return box, row
            parts = path.rstrip("/").split("/")
            prefixes = ["/".join(parts[:k]) for k in range(2, len(parts) + 1)]
            hits = sorted(box.links.where(F.col("path").isin(prefixes)).collect(), key=lambda x: len(x.path))
            if not hits:
                raise KeyError(path)
            link = hits[0]
            path = link.target_path.rstrip("/") + path[len(link.path) :] or "/"
            if link.kind == "external":
                box = Container(self.spark, f"{box.path.rpartition('/')[0]}/{link.target_file}")
        raise ValueError(f"{path}: more than {MAX_HOPS} links")

    def _dataset(self, path: str) -> tuple[Container, Row]:
        box, row = self.open(path)
        if row.kind != "dataset":
            raise KeyError(path)
        return box, row

    def _check_new(self, path: str) -> tuple[str, str, int]:
        """The path, its parent, and the next free object id."""
        bare = path.rstrip("/")
        parent = bare.rpartition("/")[0] or "/"
        at = F.col("path")
        why, group, taken, last = self.objects.agg(F.first(path_problem(F.lit(path))), F.max((at == parent) & (F.col("kind") == "group")), F.max(at == bare), F.max("object_id")).first()
        if why:
            raise ValueError(f"{path}: {why}")
        if not group:
            raise ValueError(f"{bare}: no group {parent}")
        if taken or not self.links.where(at == bare).isEmpty():
            raise ValueError(f"{bare} exists")
        return bare, parent, last + 1

    def _add(self, path: str, kind: str, dtype=None, dims=None, maxdims=None, chunk=None, folder=None) -> None:
        path, parent, new = self._check_new(path)
        row = _given(self.spark, [(path, parent, path.rpartition("/")[2], kind, new, dtype, dims, maxdims, chunk, dims, folder)], OBJECTS)
        self._commit(objects=self.objects.unionByName(row))

    def add_group(self, path: str) -> None:
        self._add(path, "group")

    def add_type(self, path: str, dtype: str) -> None:
        """A committed type."""
        spark_type(dtype)
        self._add(path, "datatype", dtype)

    def write_dataset(self, path: str, cells: DataFrame, dtype: str, dims: Sequence[int], coords: Sequence[str], value: str = "v", chunk: Sequence[int] | None = None, maxdims: Sequence[int | None] | None = None) -> None:
        """Stores a cell table; chunked ones are partitioned by their chunk columns."""
        dims = list(dims)
        why = dataset_problem(dims, chunk, maxdims)
        if why:
            raise ValueError(why)
        self._check_new(path)
        stored = cells.select(*[F.col(c).cast("long") for c in coords], F.col(value).cast(spark_type(dtype)).alias("v"))
        folder = f"data/{uuid.uuid4().hex}"
        self._write_cells(stored, folder, coords, chunk)
        written = self.spark.read.parquet(f"{self.path}/{folder}")
        if _places(written, coords, dims) != _places(arrays.grid(self.spark, dims, coords), coords, dims):
            raise ValueError(f"{path}: the cells must be {' x '.join(map(str, dims))}, each place once")
        self._add(path, "dataset", dtype, dims, None if maxdims is None else list(maxdims), None if chunk is None else list(chunk), folder)

    def _write_cells(self, rows: DataFrame, folder: str, coords: Sequence[str], chunk: Sequence[int] | None) -> None:
        if chunk is None:
            rows.sortWithinPartitions(*coords).write.parquet(f"{self.path}/{folder}")
            return
        cut = arrays.with_chunks(rows, dict(zip(coords, chunk, strict=True)))
        names = [f"chunk_{c}" for c in coords]
        cut.repartition(*names).sortWithinPartitions(*names, *coords).write.partitionBy(*names).parquet(f"{self.path}/{folder}")

    def _stored(self, row: Row) -> tuple[DataFrame, list[str]]:
        """The cells of a dataset that are still stored, and its coordinates' names."""
        rows = self.spark.read.parquet(f"{self.path}/{row.folder}")
        coords = [c for c in rows.columns if c != "v" and not c.startswith("chunk_")]
        for c, n in zip(coords, row.stored, strict=True):
            rows = rows.where(F.col(c) < n)
        return rows, coords

    def cells(self, path: str) -> DataFrame:
        """All cells of a dataset; what isn't stored is 0."""
        box, row = self._dataset(path)
        rows, coords = box._stored(row)
        kind = spark_type(row.dtype)
        nothing = F.lit("" if kind.typeName() == "string" else 0).cast(kind)
        # The array without its stored box, as one box for each dimension that has grown.
        for d, (have, n) in enumerate(zip(row.stored, row.dims, strict=True)):
            if have < n:
                size = [*row.stored[:d], n - have, *row.dims[d + 1 :]]
                box_ = arrays.grid(self.spark, size, coords).withColumn(coords[d], F.col(coords[d]) + have).withColumn("v", nothing)
                if row.chunk:
                    box_ = arrays.with_chunks(box_, dict(zip(coords, row.chunk, strict=True)))
                rows = rows.unionByName(box_)
        return rows

    def select(self, path: str, slab: Hyperslab, coords: Sequence[str], ordinals: bool = False) -> DataFrame:
        _, row = self._dataset(path)
        chunks = dict(zip(coords, row.chunk, strict=True)) if row.chunk else None
        return select(self.cells(path), slab, coords, row.dims, chunks, ordinals)

    def resize(self, path: str, new: Sequence[int]) -> None:
        """Other extents for a chunked dataset; cells beyond them are gone, also if it grows again, and new ones read as 0."""
        box, row = self._dataset(path)
        why = resize_problem(row.dims, row.maxdims, row.chunk, new)
        if why:
            raise ValueError(why)
        kept = [min(a, b) for a, b in zip(row.stored, new, strict=True)]
        box._change(row, dims=[int(n) for n in new], stored=kept)

    def _change(self, row: Row, **values) -> None:
        hit, rows = F.col("object_id") == row.object_id, self.objects
        for name, value in values.items():
            literal = F.array(*map(F.lit, value)).cast("array<bigint>") if isinstance(value, list) else F.lit(value)
            rows = rows.withColumn(name, F.when(hit, literal).otherwise(F.col(name)))
        self._commit(objects=rows)

    def add_link(self, path: str, kind: str, target_path: str, target_file: str | None = None) -> None:
        """A hard link to an existing object, a soft link to any absolute path, or an external one."""
        path, _, _ = self._check_new(path)
        if kind == "hard" and self._found(target_path) is None:
            raise ValueError(f"no object {target_path}")
        if kind not in ("hard", "soft", "external") or not target_path.startswith("/"):
            raise ValueError("links are hard, soft or external, and targets absolute paths")
        if kind == "external":
            why = self.spark.range(1).select(external_file_problem(F.lit(target_file))).first()[0]
            if why:
                raise ValueError(why)
        row = _given(self.spark, [(path, kind, target_path, target_file)], LINKS)
        self._commit(links=self.links.unionByName(row))

    def add_linked_group(self, path: str, targets: dict[str, str]) -> None:
        """A group with hard links to existing objects, by name; however many there are."""
        wanted = _given(self.spark, [(t,) for t in targets.values()] or [("/",)], "path string")
        if not wanted.join(self.objects, "path", "left_anti").isEmpty():
            raise ValueError("a link's target doesn't exist")
        self.add_group(path)
        rows = _given(self.spark, [(f"{path}/{name}", "hard", to, None) for name, to in targets.items()], LINKS)
        self._commit(links=self.links.unionByName(rows))

    def chunks(self, path: str, coords: Sequence[str], cancelled=None) -> ChunkIterator:
        """A cursor over a dataset's chunks; one that isn't chunked is a single chunk."""
        _, row = self._dataset(path)
        return ChunkIterator(self.cells(path), coords, row.dims, row.chunk or row.dims, cancelled)

    def info(self) -> DataFrame:
        """What a listing says of each dataset: ``path``, ``info``."""
        layout = F.when(F.col("chunk").isNull(), "contiguous").otherwise(F.concat(F.lit("chunked ["), F.array_join(F.col("chunk").cast("array<string>"), " "), F.lit("]")))
        return self.objects.where("kind = 'dataset'").select("path", F.concat_ws(", ", "dtype", describe(F.col("dims")), layout).alias("info"))

    def set_attribute(self, path: str, name: str, value) -> None:
        """Adds or replaces an attribute; its type is that of the value."""
        box, at = self.open(path)
        kind = attribute_type(value)
        row = _given(self.spark, [(at.path, name, kind, json.dumps(value))], ATTRIBUTES)
        box._commit(attributes=catalog.upsert_attributes(box.attributes, row))

    def attribute(self, path: str, name: str):
        box, at = self.open(path)
        row = box.attributes.where((F.col("path") == at.path) & (F.col("name") == name)).first()
        if row is None:
            raise KeyError(name)
        return json.loads(row.value)

    def delete_attribute(self, path: str, name: str) -> None:
        box, at = self.open(path)
        gone = _given(self.spark, [(at.path, name)], "path string, name string")
        box._commit(attributes=catalog.delete_attributes(box.attributes, gone))

    def walk(self) -> DataFrame:
        return catalog.walk(catalog.visible(self.objects, self.links)).select("walk_path", "walk_key", "kind", "depth", "object_id")

    def compact(self, path: str) -> None:
        """Rewrites what is stored of a dataset, one file for each chunk, in a new folder that the catalog then names."""
        box, row = self._dataset(path)
        rows, coords = box._stored(row)
        folder = f"data/{uuid.uuid4().hex}"
        box._write_cells(rows.select(*coords, "v"), folder, coords, row.chunk)
        box._change(row, folder=folder)


def _places(cells: DataFrame, coords: Sequence[str], dims: Sequence[int]) -> tuple:
    """Tells one set of places from another: their number, bounds, and sums of two hashes."""
    sums = [F.sum(F.xxhash64(F.lit(k), *[F.col(c).cast("long") for c in coords]).cast("decimal(38,0)")) for k in (1, 2)]
    return tuple(cells.agg(F.count(F.lit(1)), *sums, *[f(c) for c in coords for f in (F.min, F.max)]).first())


def dataset_problem(dims: Sequence[int], chunk: Sequence[int] | None = None, maxdims: Sequence[int | None] | None = None) -> str | None:
    """Why a dataset of these extents can't be made; None if it can."""
    if not dims or min(dims) < 1:
        return "extents must be positive"
    if chunk is not None and (len(chunk) != len(dims) or any(not 0 < c <= n for c, n in zip(chunk, dims, strict=True))):
        return "chunks must have the array's rank and 1 to extent cells in each dimension"
    if maxdims is not None:
        if chunk is None:
            return "only chunked datasets can grow"
        if len(maxdims) != len(dims) or any(m is not None and m < n for m, n in zip(maxdims, dims, strict=True)):
            return "largest extents must not be below the extents"
    return None


def resize_problem(dims: Sequence[int], maxdims: Sequence[int | None] | None, chunk: Sequence[int] | None, new: Sequence[int]) -> str | None:
    """Why a dataset can't get these extents; None if it can."""
    if chunk is None:
        return "only chunked datasets can be resized"
    if len(new) != len(dims) or min(new) < 1 or any(m is not None and n > m for n, m in zip(new, maxdims or dims, strict=True)):
        return "extents don't fit the largest ones"
    return None


def attribute_type(value) -> str:
    """The type name of an attribute's value: numbers, texts, and lists of one kind that aren't empty."""
    if isinstance(value, bool) or value is None:
        raise TypeError("attributes are numbers, texts or lists of them")
    if isinstance(value, int):
        return "int64"
    if isinstance(value, float):
        return "float64"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list) and value:
        kinds = {attribute_type(v) for v in value}
        if len(kinds) == 1:
            return f"array:{kinds.pop()}"
    raise TypeError("attributes are numbers, texts or lists of one kind that aren't empty")
