"""The hierarchical array file format: reading and writing its structures as bytes.

Written from the published format specification. The reader takes a function
``read(offset, size)`` and fetches only what a request needs: superblock versions 0
to 3, object headers 1 and 2, symbol-table, compact and dense groups, all datatype
classes that have values, compact, contiguous and chunked storage (B-tree version
1, and version 4 layouts with one chunk or implicit chunks), filters, compact and
dense attributes. The writer makes version 2 superblocks and headers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from ..functions.checksums import lookup3
from ..operators.codecs import FILTERS, Filter, apply_filters, remove_filters
from ..plans.selection import check_buffer

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = (1 << 64) - 1
MAX_DEPTH = 64
#: Most bytes of a dataset read at once, a chunk, an attribute and a string element; a file that asks for more is damaged.
MAX_DATASET, MAX_CHUNK, MAX_ATTRIBUTE, MAX_STRING = 1 << 40, 1 << 30, 64 << 20, 16 << 20
#: Message types: fixed values of the format.
SPACE, LINK_INFO, TYPE, LINK, LAYOUT, FILTER, ATTRIBUTE, CONTINUE, SYMBOLS, ATTRIBUTE_INFO = 0x01, 0x02, 0x03, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11, 0x15
#: Entries of a chunk index node.
NODE_ENTRIES = 64


class FormatError(ValueError):
    """Bytes that aren't what the format asks for, or that use a part of it that isn't read here."""


def _room(size: int, most: int, what: str) -> int:
    """A size that a structure asks for, if it may."""
    try:
        return check_buffer(size, most, what)
    except ValueError as e:
        raise FormatError(str(e)) from None


@dataclass(frozen=True)
class DataType:
    """A type: its kind, size in bytes, and what else the kind needs."""

    kind: str
    size: int
    signed: bool = False
    big: bool = False
    pad: int = 0
    base: DataType | None = None
    dims: tuple[int, ...] = ()
    members: tuple = ()
    tag: str = ""

    @property
    def numpy(self) -> np.dtype:
        if self.kind not in ("int", "float", "bitfield") or self.kind == "float" and self.size not in (2, 4, 8):
            raise FormatError(f"{self.kind} of {self.size} bytes has no number type")
        return np.dtype(f"{'>' if self.big else '<'}{'f' if self.kind == 'float' else 'i' if self.signed else 'u'}{self.size}")

    def name(self) -> str:
        if self.kind == "int":
            return f"{'' if self.signed else 'u'}int{8 * self.size}"
        if self.kind == "float":
            return f"float{8 * self.size}"
        if self.kind in ("enum", "array", "vlen"):
            return f"{self.kind}:{self.base.name()}"
        return self.kind


@dataclass
class Node:
    """An object: its header's messages, by type."""

    address: int
    messages: list[tuple[int, bytes]] = field(default_factory=list)

    def all(self, kind: int) -> list[bytes]:
        return [d for k, d in self.messages if k == kind]

    def one(self, kind: int) -> bytes | None:
        return next(iter(self.all(kind)), None)

    @property
    def kind(self) -> str:
        have = {k for k, _ in self.messages}
        if have & {SYMBOLS, LINK_INFO, LINK}:
            return "group"
        return "dataset" if SPACE in have else "datatype" if TYPE in have else "unknown"


class Cursor:
    """Reads numbers from bytes one after the other."""

    def __init__(self, data: bytes, at: int = 0, offsets: int = 8, lengths: int = 8):
        self.data, self.at, self.o, self.n = data, at, offsets, lengths

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise FormatError("cut structure")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def address(self) -> int:
        v = self.uint(self.o)
        return UNDEFINED if v == (1 << 8 * self.o) - 1 else v

    def length(self) -> int:
        return self.uint(self.n)

    def text(self, pad: bool) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode("utf-8", "replace")
        n = end - self.at + 1
        self.at += -(-n // 8) * 8 if pad else n
        return out


def parse_type(c: Cursor, depth: int = 0) -> DataType:
    if depth > MAX_DEPTH:
        raise FormatError("types nested too deeply")
    head, b0, b1, b2 = c.take(4)
    version, cls, bits, size = head >> 4, head & 15, b0 | b1 << 8 | b2 << 16, c.uint(4)
    if cls in (0, 4):
        c.take(4)
        return DataType("int" if cls == 0 else "bitfield", size, bool(bits & 8) and cls == 0, bool(bits & 1))
    if cls == 1:
        c.take(12)
        return DataType("float", size, True, bool(bits & 1))
    if cls == 3:
        return DataType("string", size, pad=bits & 15)
    if cls == 5:
        return DataType("opaque", size, tag=c.take(bits & 255).rstrip(b"\0").decode("ascii", "replace"))
    if cls == 7:
        return DataType("region_reference" if bits & 15 else "object_reference", size)
    if cls == 6:
        members = []
        for _ in range(bits & 0xFFFF):
            name = c.text(version < 3)
            offset = c.uint(4 if version < 3 else max(1, (size.bit_length() + 7) // 8))
            shape: tuple[int, ...] = ()
            if version == 1:
                rank = c.uint(1)
                c.take(11)
                shape = tuple(c.uint(4) for _ in range(4))[:rank]
            kind = parse_type(c, depth + 1)
            members.append((name, offset, DataType("array", kind.size * math.prod(shape), base=kind, dims=shape) if shape else kind))
        return DataType("compound", size, members=tuple(members))
    if cls == 8:
        base = parse_type(c, depth + 1)
        names = [c.text(version < 3) for _ in range(bits & 0xFFFF)]
        return DataType("enum", size, base=base, members=tuple((n, int(np.frombuffer(c.take(base.size), base.numpy)[0])) for n in names))
    if cls == 9:
        base = parse_type(c, depth + 1)
        return DataType("vlen_string" if bits & 15 == 1 else "vlen", size, base=base, pad=bits >> 4 & 15)
    if cls == 10:
        rank = c.uint(1)
        if version < 3:
            c.take(3)
        dims = tuple(c.uint(4) for _ in range(rank))
        if version < 3:
            c.take(4 * rank)
        return DataType("array", size, base=parse_type(c, depth + 1), dims=dims)
    raise FormatError(f"values of datatype class {cls} aren't read")


def parse_space(data: bytes, lengths: int = 8) -> tuple[list[int] | None, list[int | None] | None]:
    """Extents and largest extents; no extents for a scalar, None for a null space."""
    c = Cursor(data, lengths=lengths)
    version, rank, flags = c.take(3)
    kind = c.uint(1)
    if version == 1:
        c.take(4)
    elif version != 2:
        raise FormatError("unknown dataspace version")
    elif kind == 2:
        return None, None
    dims = [c.length() for _ in range(rank)]
    most = [c.length() for _ in range(rank)] if flags & 1 else None
    return dims, None if most is None else [None if m == (1 << 8 * lengths) - 1 else m for m in most]


@dataclass
class Storage:
    """Where a dataset's bytes are."""

    kind: str
    address: int = UNDEFINED
    size: int = 0
    data: bytes = b""
    chunk: tuple[int, ...] = ()
    index: int = 0
    mask: int = 0


@dataclass(frozen=True)
class Chunk:
    offset: tuple[int, ...]
    address: int
    size: int
    mask: int


def _plain(values) -> list:
    """Python's own numbers instead of the arrays'."""
    return values.tolist() if isinstance(values, np.ndarray) else values


class H5File:
    """A file's catalog and values."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.fetch, self.size = read, size
        self.o = self.n = 8
        self._heaps: dict[int, dict[int, bytes]] = {}
        self._open()

    @classmethod
    def of(cls, data: bytes) -> H5File:
        return cls(lambda at, n: data[at : at + n], len(data))

    def _bytes(self, at: int, n: int) -> bytes:
        if at == UNDEFINED or at < 0 or n < 0 or at + n > self.size:
            raise FormatError(f"{n} bytes at {at} lie outside the file")
        out = self.fetch(at, n)
        if len(out) != n:
            raise FormatError("cut file")
        return out

    def _cursor(self, at: int, n: int) -> Cursor:
        return Cursor(self._bytes(at, n), 0, self.o, self.n)

    def _open(self) -> None:
        base = 0
        while self.size >= base + 8 and self.fetch(base, 8) != SIGNATURE:
            base = base * 2 or 512
        if self.size < base + 24:
            raise FormatError("no signature")
        if base:
            fetch = self.fetch
            self.fetch, self.size = (lambda at, n: fetch(at + base, n)), self.size - base
        head = self._bytes(8, 8)
        self.version = head[0]
        if self.version in (0, 1):
            self.o, self.n = head[5], head[6]
            at = 16 + 8 + (4 if self.version else 0)
            c = self._cursor(at, 5 * self.o + self.o + 24)
            c.take(4 * self.o)
            c.address()
            self.root = c.address()
        elif self.version in (2, 3):
            self.o, self.n = head[1], head[2]
            whole = self._bytes(0, 12 + 4 * self.o + 4)
            if lookup3(whole[:-4]) != int.from_bytes(whole[-4:], "little"):
                raise FormatError("wrong checksum of the superblock")
            c = Cursor(whole, 12 + 3 * self.o, self.o, self.n)
            self.root = c.address()
        else:
            raise FormatError(f"superblock version {self.version}")
        if self.root >= self.size:
            raise FormatError("the root lies outside the file")

    # Object headers

    def node(self, address: int) -> Node:
        out, start = Node(address), self._bytes(address, 4)
        blocks: list[tuple[int, int]] = []
        if start == b"OHDR":
            flags = self._bytes(address + 5, 1)[0]
            at = address + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self._bytes(at, width), "little")
            whole = self._bytes(address, at + width - address + size + 4)
            if lookup3(whole[:-4]) != int.from_bytes(whole[-4:], "little"):
                raise FormatError("wrong checksum of an object header")
            blocks.append((at + width, size))
            second = True
        elif start[0] == 1:
            c = self._cursor(address, 16)
            c.take(8)
            blocks.append((address + 16, c.uint(4)))
            flags, second = 0, False
        else:
            raise FormatError("no object header")
        seen = set()
        while blocks:
            at, size = blocks.pop(0)
            if at in seen:
                raise FormatError("a header goes on in itself")
            seen.add(at)
            c = self._cursor(at, size)
            step = (6 if flags & 4 else 4) if second else 8
            while len(c.data) - c.at >= step:
                if second:
                    kind, n, _ = c.uint(1), c.uint(2), c.uint(1)
                    if flags & 4:
                        c.take(2)
                else:
                    kind, n = c.uint(2), c.uint(2)
                    c.take(4)
                data = c.take(n)
                if kind == CONTINUE:
                    m = Cursor(data, 0, self.o, self.n)
                    to, length = m.address(), m.length()
                    if second:
                        part = self._bytes(to, length)
                        if part[:4] != b"OCHK" or lookup3(part[:-4]) != int.from_bytes(part[-4:], "little"):
                            raise FormatError("wrong checksum of a header's continuation")
                        blocks.append((to + 4, length - 8))
                    else:
                        blocks.append((to, length))
                elif kind:
                    out.messages.append((kind, data))
        return out

    # Groups

    def children(self, node: Node) -> list[tuple[str, str, int | str]]:
        """(name, kind of link, address or target) of each link of a group."""
        out = [self._link(d) for d in node.all(LINK)]
        if info := node.one(LINK_INFO):
            c = Cursor(info, 0, self.o, self.n)
            c.take(1)
            if c.uint(1) & 1:
                c.take(8)
            heap, index = c.address(), c.address()
            if heap != UNDEFINED and index != UNDEFINED:
                out += [self._link(self._heap_object(heap, record[4:])) for record in self._records(index)]
        if table := node.one(SYMBOLS):
            c = Cursor(table, 0, self.o, self.n)
            out += self._symbols(c.address(), c.address())
        return out

    def _link(self, data: bytes) -> tuple[str, str, int | str]:
        c = Cursor(data, 0, self.o, self.n)
        c.take(1)
        flags = c.uint(1)
        kind = c.uint(1) if flags & 8 else 0
        if flags & 4:
            c.take(8)
        if flags & 16:
            c.take(1)
        name = c.take(c.uint(1 << (flags & 3))).decode("utf-8", "replace")
        if kind == 0:
            return name, "hard", c.address()
        value = c.take(c.uint(2))
        if kind == 1:
            return name, "soft", value.decode("utf-8", "replace")
        file, path = value[1:].split(b"\0")[:2]
        return name, "external", f"{file.decode('utf-8', 'replace')}\0{path.decode('utf-8', 'replace')}"

    def _symbols(self, tree: int, heap: int) -> list[tuple[str, str, int | str]]:
        c = self._cursor(heap, 8 + 2 * self.n + self.o)
        if c.take(4) != b"HEAP":
            raise FormatError("no local heap")
        c.take(4)
        size, _ = c.length(), c.length()
        names = self._bytes(c.address(), size)
        text = lambda at: names[at : names.index(b"\0", at)].decode("utf-8", "replace")
        out = []
        for leaf in self._leaves(tree, 0, self.n):
            head = self._bytes(leaf, 8)
            if head[:4] != b"SNOD":
                raise FormatError("no symbol node")
            step = 2 * self.o + 24
            count = int.from_bytes(head[6:8], "little")
            c = self._cursor(leaf + 8, step * count)
            for _ in range(count):
                name, at, cache = c.uint(self.o), c.address(), c.uint(4)
                c.take(4)
                scratch = c.take(16)
                if cache == 2:
                    out.append((text(name), "soft", text(int.from_bytes(scratch[:4], "little"))))
                else:
                    out.append((text(name), "hard", at))
        return out

    def _leaves(self, tree: int, kind: int, key: int) -> Iterator[int]:
        """The children of a tree's lowest nodes."""
        for _, child in self._entries(tree, kind, key, set()):
            yield child

    def _entries(self, tree: int, kind: int, key: int, seen: set[int]) -> Iterator[tuple[bytes, int]]:
        if tree in seen:
            return
        seen.add(tree)
        head = self._cursor(tree, 8 + 2 * self.o)
        if head.take(4) != b"TREE" or head.uint(1) != kind:
            raise FormatError("no tree node")
        level, used = head.uint(1), head.uint(2)
        c = self._cursor(tree + 8 + 2 * self.o, used * (key + self.o))
        for _ in range(used):
            k, child = c.take(key), c.address()
            if level:
                yield from self._entries(child, kind, key, seen)
            else:
                yield k, child

    # Dense storage

    def _records(self, address: int) -> Iterator[bytes]:
        c = self._cursor(address, 22 + self.o + self.n)
        if c.take(4) != b"BTHD":
            raise FormatError("no index")
        c.take(2)
        node, size, depth = c.uint(4), c.uint(2), c.uint(2)
        c.take(2)
        root, count = c.address(), c.uint(2)
        if root != UNDEFINED and count:
            # The most records below a node of each depth say how many bytes its counts have.
            most, totals = [(node - 10) // size], [(node - 10) // size]
            width = lambda v: max(1, (v.bit_length() + 7) // 8)
            for d in range(1, depth + 1):
                pointer = self.o + width(most[0]) + (width(totals[d - 1]) if d > 1 else 0)
                most.append((node - 10 - pointer) // (size + pointer))
                totals.append((most[d] + 1) * totals[d - 1] + most[d])
            yield from self._index_node(root, count, depth, size, [width(most[0])] * (depth + 1), [width(t) for t in totals])

    def _index_node(self, address: int, count: int, depth: int, size: int, widths: list[int], totals: list[int]) -> Iterator[bytes]:
        extra = 0 if not depth else (count + 1) * (self.o + widths[0] + (totals[depth - 1] if depth > 1 else 0))
        c = self._cursor(address, 6 + count * size + extra)
        if c.take(6)[:4] != (b"BTIN" if depth else b"BTLF"):
            raise FormatError("no index node")
        records = [c.take(size) for _ in range(count)]
        if not depth:
            yield from records
            return
        for k in range(count + 1):
            child, n = c.address(), c.uint(widths[0])
            if depth > 1:
                c.take(totals[depth - 1])
            yield from self._index_node(child, n, depth - 1, size, widths, totals)
            yield from records[k : k + 1]

    def _heap_object(self, heap: int, key: bytes) -> bytes:
        c = self._cursor(heap, 26 + 12 * self.n + 3 * self.o)
        if c.take(4) != b"FRHP":
            raise FormatError("no fractal heap")
        c.take(3)
        filters, flags, largest = c.uint(2), c.uint(1), c.uint(4)
        if filters:
            raise FormatError("filtered heaps aren't read")
        c.take(self.n)
        c.address()
        c.length()
        c.address()
        c.take(8 * self.n)
        width, start, most = c.uint(2), c.length(), c.length()
        bits, _ = c.uint(2), c.uint(2)
        root, rows = c.address(), c.uint(2)
        kind = key[0] >> 4 & 3
        if kind == 2:
            n = (key[0] & 15) + 1
            return key[1 : 1 + n]
        if kind == 1:
            raise FormatError("huge heap objects aren't read")
        offset_bytes = (bits + 7) // 8
        length_bytes = max(1, (min(most, largest).bit_length() + 7) // 8)
        offset = int.from_bytes(key[1 : 1 + offset_bytes], "little")
        n = int.from_bytes(key[1 + offset_bytes : 1 + offset_bytes + length_bytes], "little")
        while rows:
            # An indirect block: find the row, then the block in it, whose sizes double from the second row on.
            direct = (most // start).bit_length() + 1
            at, row, size = 0, 0, start
            while offset >= at + width * size:
                at, row = at + width * size, row + 1
                size = start << max(0, row - 1)
            column = (offset - at) // size
            entry = root + 5 + self.o + offset_bytes + (row * width + column) * self.o
            if self._bytes(root, 4) != b"FHIB":
                raise FormatError("no indirect block")
            root, offset = self._cursor(entry, self.o).address(), offset - at - column * size
            if row < direct:
                break
            rows = (size // (start * width)).bit_length()
        if self._bytes(root, 4) != b"FHDB":
            raise FormatError("no direct block")
        return self._bytes(root + offset, n)

    # Datasets and attributes

    def type_of(self, node: Node) -> DataType:
        return parse_type(Cursor(node.one(TYPE), 0, self.o, self.n))

    def shape_of(self, node: Node):
        return parse_space(node.one(SPACE), self.n)

    def filters_of(self, node: Node) -> list[Filter]:
        data = node.one(FILTER)
        if not data:
            return []
        c = Cursor(data)
        version, count = c.uint(1), c.uint(1)
        if version == 1:
            c.take(6)
        out = []
        for _ in range(count):
            number = c.uint(2)
            named = c.uint(2) if version == 1 or number >= 256 else 0
            flags, values = c.uint(2), c.uint(2)
            c.take(-(-named // 8) * 8 if version == 1 else named)
            given = [c.uint(4) for _ in range(values)]
            if version == 1 and values % 2:
                c.take(4)
            name = FILTERS.get(number, str(number))
            # LZF's third value is the size of the unpacked data.
            value = given[2] if name == "lzf" and len(given) > 2 else given[0] if given else 0
            out.append(Filter(name, value, bool(flags & 1)))
        return out

    def storage_of(self, node: Node) -> Storage:
        c = Cursor(node.one(LAYOUT), 0, self.o, self.n)
        version = c.uint(1)
        if version not in (3, 4):
            raise FormatError(f"layout version {version}")
        kind = c.uint(1)
        if kind == 0:
            return Storage("compact", data=c.take(c.uint(2)))
        if kind == 1:
            return Storage("contiguous", c.address(), c.length())
        if kind != 2:
            raise FormatError("virtual datasets aren't read")
        if version == 3:
            rank, address = c.uint(1), c.address()
            return Storage("chunked", address, chunk=tuple(c.uint(4) for _ in range(rank - 1)))
        flags, rank, width = c.uint(1), c.uint(1), c.uint(1)
        chunk = tuple(c.uint(width) for _ in range(rank))[:-1]
        index, size, mask = c.uint(1), 0, 0
        if index == 1 and flags & 2:
            size, mask = c.length(), c.uint(4)
        if index not in (1, 2):
            raise FormatError(f"chunk index {index} isn't read")
        return Storage("chunked", c.address(), size, chunk=chunk, index=index, mask=mask)

    def chunks_of(self, node: Node) -> Iterator[Chunk]:
        """The stored chunks of a chunked dataset."""
        s, (dims, _), size = self.storage_of(node), self.shape_of(node), self.type_of(node).size
        if s.address == UNDEFINED:
            return
        full = math.prod(s.chunk) * size
        if s.index == 1:
            yield Chunk((0,) * len(dims), s.address, s.size or full, s.mask)
        elif s.index == 2:
            counts = [-(-n // k) for n, k in zip(dims, s.chunk, strict=True)]
            for i in range(math.prod(counts)):
                at = np.unravel_index(i, counts)
                yield Chunk(tuple(int(a) * k for a, k in zip(at, s.chunk, strict=True)), s.address + i * full, full, 0)
        else:
            rank = len(s.chunk)
            for key, child in self._entries(s.address, 1, 8 + 8 * (rank + 1), set()):
                c = Cursor(key)
                stored, mask = c.uint(4), c.uint(4)
                yield Chunk(tuple(c.uint(8) for _ in range(rank)), child, stored, mask)

    def chunk_cells(self, node: Node) -> int:
        """Cells of a whole chunk, whose bytes are within the limit."""
        cells = math.prod(self.storage_of(node).chunk)
        _room(cells * self.type_of(node).size, MAX_CHUNK, "a chunk")
        return cells

    def chunk_values(self, node: Node, chunk: Chunk) -> np.ndarray | list:
        """All cells of one chunk, also those beyond the array's edge, in row-major order."""
        cells = self.chunk_cells(node)
        _room(chunk.size, MAX_CHUNK, "a stored chunk")
        data = remove_filters(self._bytes(chunk.address, chunk.size), self.filters_of(node), chunk.mask)
        return self.decode(data, self.type_of(node), cells)

    def raw(self, node: Node, first: int = 0, count: int | None = None) -> bytes:
        """Bytes of elements ``first`` and on of a compact or contiguous dataset; nothing stored reads as zeros."""
        s, (dims, _), size = self.storage_of(node), self.shape_of(node), self.type_of(node).size
        n = (0 if dims is None else math.prod(dims)) - first if count is None else count
        if n:
            _room(n * size, MAX_DATASET, "a dataset")
        if s.kind == "compact":
            return s.data[first * size : (first + n) * size]
        return bytes(n * size) if s.address == UNDEFINED else self._bytes(s.address + first * size, n * size)

    def values(self, node: Node):
        """All elements of a dataset in row-major order."""
        kind, (dims, _) = self.type_of(node), self.shape_of(node)
        if dims is None:
            return []
        s = self.storage_of(node)
        if s.kind != "chunked":
            return self.decode(self.raw(node), kind, math.prod(dims))
        if math.prod(dims):
            _room(math.prod(dims) * kind.size, MAX_DATASET, "a dataset")
        parts = []
        for chunk in self.chunks_of(node):
            parts.append((chunk, self.chunk_values(node, chunk)))
        whole = np.zeros(dims, kind.numpy) if kind.kind in ("int", "float") else np.full(dims, None, object)
        for chunk, cells in parts:
            block = np.empty(len(cells), whole.dtype)
            block[:] = cells
            block = block.reshape(s.chunk)
            place = tuple(slice(o, min(o + k, n)) for o, k, n in zip(chunk.offset, s.chunk, dims, strict=True))
            whole[place] = block[tuple(slice(0, p.stop - p.start) for p in place)]
        return whole.reshape(-1) if whole.dtype != object else list(whole.reshape(-1))

    def decode(self, data: bytes, kind: DataType, count: int):
        """``count`` elements of a type: numbers as an array, others as a list."""
        if kind.kind in ("int", "float", "bitfield"):
            return np.frombuffer(data, kind.numpy, count)
        if kind.kind == "enum":
            return np.frombuffer(data, kind.base.numpy, count)
        size = kind.size
        if kind.kind == "string":
            _room(size, MAX_STRING, "a string element")
        pieces = [data[i * size : (i + 1) * size] for i in range(count)]
        if kind.kind == "string":
            return [self._string(p, kind.pad) for p in pieces]
        if kind.kind == "object_reference":
            return [int.from_bytes(p, "little") for p in pieces]
        if kind.kind in ("opaque", "region_reference"):
            return pieces
        if kind.kind == "array":
            n = math.prod(kind.dims)
            return [_plain(self.decode(p, kind.base, n)) for p in pieces]
        if kind.kind == "compound":
            columns = [_plain(self.decode(b"".join(p[o : o + t.size] for p in pieces), t, count)) for _, o, t in kind.members]
            return [dict(zip([m[0] for m in kind.members], row, strict=True)) for row in zip(*columns, strict=True)]
        if kind.kind in ("vlen", "vlen_string"):
            return [self._vlen(p, kind) for p in pieces]
        raise FormatError(f"{kind.kind} values aren't read")

    @staticmethod
    def _string(data: bytes, pad: int) -> str:
        data = data.split(b"\0", 1)[0] if pad == 0 else data.rstrip(b"\0" if pad == 1 else b" ")
        return data.decode("utf-8", "replace")

    def _vlen(self, data: bytes, kind: DataType):
        c = Cursor(data, 0, self.o, self.n)
        n, heap, index = c.uint(4), c.address(), c.uint(4)
        octets = kind.kind == "vlen" and kind.base.name() == "uint8"
        if not n or heap in (0, UNDEFINED):
            return "" if kind.kind == "vlen_string" else b"" if octets else []
        if kind.kind == "vlen_string":
            _room(n, MAX_STRING, "a string element")
        if heap not in self._heaps:
            self._heaps[heap] = self._collection(heap)
        if index not in self._heaps[heap]:
            raise FormatError("a dangling heap reference")
        value = self._heaps[heap][index]
        if kind.kind == "vlen_string":
            return value[:n].rstrip(b"\0").decode("utf-8", "replace")
        if octets:
            return value[:n]
        return _plain(self.decode(value, kind.base, n))

    def _collection(self, address: int) -> dict[int, bytes]:
        c = self._cursor(address, 8 + self.n)
        if c.take(4) != b"GCOL":
            raise FormatError("no global heap")
        c.take(4)
        c = self._cursor(address, c.length())
        c.at = 8 + self.n
        out = {}
        while len(c.data) - c.at >= 8 + self.n:
            index = c.uint(2)
            c.take(6)
            size = c.length()
            if not index:
                break
            out[index] = c.take(size)
            c.take(min(-size % 8, len(c.data) - c.at))
        return out

    def attributes(self, node: Node) -> Iterator[tuple[str, DataType, list[int] | None, object]]:
        """(name, type, extents, values) of each attribute."""
        found = node.all(ATTRIBUTE)
        if info := node.one(ATTRIBUTE_INFO):
            c = Cursor(info, 0, self.o, self.n)
            c.take(1)
            if c.uint(1) & 1:
                c.take(2)
            heap, index = c.address(), c.address()
            if heap != UNDEFINED and index != UNDEFINED:
                found += [self._heap_object(heap, record[:8]) for record in self._records(index)]
        for data in found:
            c = Cursor(data, 0, self.o, self.n)
            version = c.uint(1)
            c.take(1)
            sizes = [c.uint(2) for _ in range(3)]
            if version == 3:
                c.take(1)
            elif version not in (1, 2):
                raise FormatError("unknown attribute version")
            name, kind, space = (c.take(-(-s // 8) * 8 if version == 1 else s)[:s] for s in sizes)
            of, (dims, _) = parse_type(Cursor(kind, 0, self.o, self.n)), parse_space(space, self.n)
            count = 0 if dims is None else math.prod(dims)
            if count:
                _room(count * of.size, MAX_ATTRIBUTE, "an attribute")
            yield name.rstrip(b"\0").decode("utf-8", "replace"), of, dims, self.decode(c.take(count * of.size), of, count)

    def walk(self) -> Iterator[tuple[str, str, Node | str]]:
        """(path, kind, object or target) depth first, children by name; group paths end in a slash."""
        yield from self._walk("/", self.root, (), 0)

    def _walk(self, path: str, address: int, above: tuple[int, ...], depth: int):
        node = self.node(address)
        yield path, node.kind, node
        if node.kind != "group" or address in above or depth > MAX_DEPTH:
            return
        for name, kind, to in sorted(self.children(node)):
            if kind != "hard":
                yield path + name, kind, to
                continue
            child = self.node(to)
            if child.kind == "group":
                yield from self._walk(f"{path}{name}/", to, (*above, address), depth + 1)
            else:
                yield path + name, child.kind, child

    def find(self, path: str) -> Node:
        address = self.root
        for part in [p for p in path.split("/") if p]:
            links = {n: (k, to) for n, k, to in self.children(self.node(address))}
            kind, to = links.get(part, (None, None))
            if kind == "soft":
                return self.find(to)
            if kind != "hard":
                raise KeyError(path)
            address = to
        return self.node(address)


# Writing


def _u(v: int, n: int) -> bytes:
    return v.to_bytes(n, "little")


def _checked(data: bytes) -> bytes:
    return data + _u(lookup3(data), 4)


def type_message(kind: DataType) -> bytes:
    big = int(kind.big)
    if kind.kind == "int":
        return bytes([0x10, big | 8 * kind.signed, 0, 0]) + _u(kind.size, 4) + _u(0, 2) + _u(8 * kind.size, 2)
    if kind.kind == "float":
        e, m = {2: (5, 10), 4: (8, 23), 8: (11, 52)}[kind.size]
        return bytes([0x11, 0x20 | big, 8 * kind.size - 1, 0]) + _u(kind.size, 4) + _u(0, 2) + _u(8 * kind.size, 2) + bytes([m, e, 0, m]) + _u((1 << (e - 1)) - 1, 4)
    if kind.kind == "string":
        return bytes([0x13, kind.pad | 0x10, 0, 0]) + _u(kind.size, 4)
    if kind.kind == "opaque":
        tag = kind.tag.encode("ascii")
        tag = tag.ljust(-(-max(1, len(tag)) // 8) * 8, b"\0")
        return bytes([0x15, len(tag), 0, 0]) + _u(kind.size, 4) + tag
    if kind.kind == "object_reference":
        return bytes([0x17, 0, 0, 0]) + _u(8, 4)
    if kind.kind == "vlen_string":
        return bytes([0x19, 0x01, 0x01, 0]) + _u(16, 4) + type_message(DataType("int", 1))
    if kind.kind == "vlen":
        return bytes([0x19, 0, 0, 0]) + _u(16, 4) + type_message(kind.base)
    if kind.kind == "array":
        return bytes([0x3A, 0, 0, 0]) + _u(kind.size, 4) + bytes([len(kind.dims)]) + b"".join(_u(d, 4) for d in kind.dims) + type_message(kind.base)
    if kind.kind == "enum":
        names = b"".join(n.encode() + b"\0" for n, _ in kind.members)
        values = b"".join(np.array([v], kind.base.numpy).tobytes() for _, v in kind.members)
        return bytes([0x38]) + _u(len(kind.members), 3) + _u(kind.size, 4) + type_message(kind.base) + names + values
    if kind.kind == "compound":
        width = max(1, (kind.size.bit_length() + 7) // 8)
        members = b"".join(n.encode() + b"\0" + _u(o, width) + type_message(t) for n, o, t in kind.members)
        return bytes([0x36]) + _u(len(kind.members), 3) + _u(kind.size, 4) + members
    raise FormatError(f"{kind.kind} can't be written")


def space_message(dims: Sequence[int] | None, most: Sequence[int | None] | None = None) -> bytes:
    if dims is None:
        return bytes([2, 0, 0, 2])
    out = bytes([2, len(dims), int(most is not None), 1 if dims else 0]) + b"".join(_u(d, 8) for d in dims)
    return out + b"".join(_u(UNDEFINED if m is None else m, 8) for m in most or ())


def type_named(name: str) -> DataType:
    """The little-endian type of a name such as int32 or float64."""
    if name.startswith("float"):
        return DataType("float", int(name[5:]) // 8, True)
    if name.lstrip("u").startswith("int"):
        return DataType("int", int(name.lstrip("u")[3:]) // 8, not name.startswith("u"))
    raise FormatError(f"no number type {name}")


class H5Writer:
    """Writes a file front to back: ``write(bytes)`` appends, ``patch(offset, bytes)`` goes back once, for the superblock."""

    def __init__(self, write: Callable[[bytes], object], patch: Callable[[int, bytes], object]):
        self._write, self._patch, self.at = write, patch, 0
        self._links: dict[str, list[tuple[str, str, int | str]]] = {"/": []}
        self._attributes: dict[str, list[bytes]] = {"/": []}
        self.put(bytes(48))

    def put(self, data: bytes) -> int:
        self._write(bytes(-self.at % 8))
        self.at += -self.at % 8
        at = self.at
        self._write(data)
        self.at += len(data)
        return at

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(bytes([k]) + _u(len(d), 2) + b"\0" + d for k, d in messages)
        return self.put(_checked(b"OHDR" + bytes([2, 2]) + _u(len(body), 4) + body))

    def _named(self, path: str) -> tuple[str, str]:
        group, _, name = path.rpartition("/")
        group = group or "/"
        if not name or group not in self._links:
            raise ValueError(f"{path}: no group {group}")
        if any(n == name for n, _, _ in self._links[group]):
            raise ValueError(f"{path} exists")
        return group, name

    def group(self, path: str) -> None:
        group, name = self._named(path)
        self._links[group].append((name, "group", path))
        self._links[path], self._attributes[path] = [], []

    def link(self, path: str, kind: str, target: str) -> None:
        """A soft link to a path, or an external one to ``file NUL path``."""
        group, name = self._named(path)
        self._links[group].append((name, kind, target))

    def hard(self, path: str, address: int) -> None:
        group, name = self._named(path)
        self._links[group].append((name, "hard", address))

    def heap(self, values: list[bytes]) -> list[bytes]:
        """Stores values out of line; gives each one's reference without its count."""
        out = []
        for k in range(0, len(values), 1000):
            part = values[k : k + 1000]
            body = b"".join(_u(i, 2) + _u(1, 2) + bytes(4) + _u(len(v), 8) + v + bytes(-len(v) % 8) for i, v in enumerate(part, 1)) + bytes(16)
            size = max(4096, 16 + len(body))
            free = size - 16 - len(body)
            body = body[:-16] + _u(0, 2) + bytes(6) + _u(free + 16, 8) + bytes(free)
            at = self.put(b"GCOL" + bytes([1, 0, 0, 0]) + _u(size, 8) + body)
            out += [_u(at, 8) + _u(i, 4) for i in range(1, len(part) + 1)]
        return out

    def encode(self, values, kind: DataType) -> bytes:
        if kind.kind in ("int", "float"):
            return np.asarray(values).astype(kind.numpy).tobytes()
        if kind.kind == "enum":
            return np.asarray(values).astype(kind.base.numpy).tobytes()
        if kind.kind == "string":
            fill = b" " if kind.pad == 2 else b"\0"
            return b"".join(v.encode()[: kind.size].ljust(kind.size, fill) for v in values)
        if kind.kind == "opaque":
            return b"".join(bytes(v)[: kind.size].ljust(kind.size, b"\0") for v in values)
        if kind.kind == "object_reference":
            return b"".join(_u(v, 8) for v in values)
        if kind.kind == "array":
            return b"".join(self.encode(v, kind.base) for v in values)
        if kind.kind == "compound":
            rows = [bytearray(kind.size) for _ in values]
            for name, at, of in kind.members:
                column = self.encode([v[name] for v in values], of)
                for i, row in enumerate(rows):
                    row[at : at + of.size] = column[i * of.size : (i + 1) * of.size]
            return b"".join(map(bytes, rows))
        if kind.kind in ("vlen", "vlen_string"):
            data = [v.encode() if isinstance(v, str) else bytes(v) if isinstance(v, bytes) else self.encode(v, kind.base) for v in values]
            places = self.heap(data)
            return b"".join(_u(len(v.encode()) if isinstance(v, str) else len(v), 4) + p for v, p in zip(values, places, strict=True))
        raise FormatError(f"{kind.kind} can't be written")

    def attribute(self, name: str, kind: DataType, dims: Sequence[int], values) -> bytes:
        """An attribute message, for ``dataset`` or ``annotate``."""
        n, t, s = name.encode() + b"\0", type_message(kind), space_message(dims)
        return bytes([3, 0]) + _u(len(n), 2) + _u(len(t), 2) + _u(len(s), 2) + b"\1" + n + t + s + self.encode(values, kind)

    def annotate(self, path: str, message: bytes) -> None:
        self._attributes[path].append(message)

    def committed_type(self, path: str, kind: DataType) -> None:
        self.hard(path, self._header([(TYPE, type_message(kind))]))

    def dataset(self, path: str, kind: DataType, dims: Sequence[int] | None, values, attributes: Sequence[bytes] = ()) -> int:
        """A contiguous dataset."""
        data = b"" if dims is None else self.encode(values, kind)
        if dims is not None and len(data) != math.prod(dims) * kind.size:
            raise ValueError("the values don't fill the extents")
        at = self.put(data) if data else UNDEFINED
        return self._finish(path, kind, dims, None, bytes([3, 1]) + _u(at, 8) + _u(len(data), 8), [], attributes)

    def chunked(self, path: str, kind: DataType, dims: Sequence[int], chunk: Sequence[int], parts: Iterator[tuple[tuple[int, ...], bytes]], filters: Sequence[Filter] = (), most: Sequence[int | None] | None = None, attributes: Sequence[bytes] = (), ready: bool = False) -> int:
        """A chunked dataset of (offset, bytes of a whole chunk), which ``ready`` ones have the filters applied to."""
        entries = []
        for offset, data in parts:
            stored = data if ready else apply_filters(data, list(filters))
            entries.append((tuple(offset), self.put(stored), len(stored)))
        entries.sort()
        key = lambda e: _u(e[2], 4) + _u(0, 4) + b"".join(_u(o, 8) for o in (*e[0], 0))
        last = _u(0, 8) + b"".join(_u(-(-n // c) * c, 8) for n, c in zip(dims, chunk, strict=True)) + _u(kind.size, 8)
        nodes, level = [(key(e), e[1]) for e in entries], 0
        root = UNDEFINED
        while nodes:
            width, above = len(last) + 8, []
            groups = [nodes[i : i + NODE_ENTRIES] for i in range(0, len(nodes), NODE_ENTRIES)]
            self.put(b"")
            at = [self.at + -self.at % 8 + i * (24 + NODE_ENTRIES * width + len(last)) for i in range(len(groups))]
            at = [a + (-a % 8) for a in at]
            for i, g in enumerate(groups):
                after = groups[i + 1][0][0] if i + 1 < len(groups) else last
                body = b"".join(k + _u(c, 8) for k, c in g) + after
                node = b"TREE" + bytes([1, level]) + _u(len(g), 2) + _u(at[i - 1] if i else UNDEFINED, 8) + _u(at[i + 1] if i + 1 < len(groups) else UNDEFINED, 8) + body
                above.append((g[0][0], self.put(node.ljust(24 + NODE_ENTRIES * width + len(last), b"\0"))))
            root = above[0][1]
            if len(above) == 1:
                break
            nodes, level = above, level + 1
        layout = bytes([3, 2, len(dims) + 1]) + _u(root, 8) + b"".join(_u(c, 4) for c in chunk) + _u(kind.size, 4)
        return self._finish(path, kind, dims, most, layout, list(filters), attributes)

    def _finish(self, path, kind, dims, most, layout, filters, attributes) -> int:
        messages = [(SPACE, space_message(dims, most)), (TYPE, type_message(kind)), (LAYOUT, layout)]
        if filters:
            numbers = {v: k for k, v in FILTERS.items()}
            body = bytes([1, len(filters)]) + bytes(6)
            for f in filters:
                given = [] if f.name == "fletcher32" else [0, 0, f.value] if f.name == "lzf" else [f.value or (6 if f.name == "deflate" else 1)]
                body += _u(numbers[f.name], 2) + _u(0, 2) + _u(int(f.optional), 2) + _u(len(given), 2) + b"".join(_u(g, 4) for g in given) + bytes(4 * (len(given) % 2))
            messages.append((FILTER, body))
        at = self._header(messages + [(ATTRIBUTE, a) for a in attributes])
        self.hard(path, at)
        return at

    def close(self) -> None:
        """Writes the groups, those below first, and the superblock."""
        places: dict[str, int] = {}
        for path in sorted(self._links, key=lambda p: -p.count("/") if p != "/" else 1):
            messages = [(LINK_INFO, bytes([0, 0]) + _u(UNDEFINED, 8) * 2)]
            for name, kind, to in sorted(self._links[path]):
                n = name.encode()
                head = bytes([1, 0x19, {"soft": 1, "external": 64}.get(kind, 0), 1]) + _u(len(n), 2) + n
                if kind in ("hard", "group"):
                    body = _u(places[to] if kind == "group" else to, 8)
                else:
                    value = to.encode() if kind == "soft" else b"\0" + to.encode() + b"\0"
                    body = _u(len(value), 2) + value
                messages.append((LINK, head + body))
            places[path] = self._header(messages + [(ATTRIBUTE, a) for a in self._attributes[path]])
        head = SIGNATURE + bytes([2, 8, 8, 0]) + _u(0, 8) + _u(UNDEFINED, 8) + _u(self.at, 8) + _u(places["/"], 8)
        self._patch(0, _checked(head))
