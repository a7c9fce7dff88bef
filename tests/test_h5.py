import itertools

import numpy as np
import pytest

from latticework.functions.checksums import lookup3
from latticework.operators.codecs import Filter
from latticework.plans.selection import Hyperslab
from latticework.sources import h5
from latticework.sources.h5format import DataType, FormatError, H5File, type_named

I32 = type_named("int32")
RECORD = DataType("compound", 24, members=(("Serial number", 0, type_named("int64")), ("place", 8, DataType("string", 8, pad=2)), ("t", 16, type_named("float64"))))


def chunks(a, c):
    for at in itertools.product(*[range(0, n, k) for n, k in zip(a.shape, c, strict=True)]):
        block = np.zeros(c, a.dtype)
        part = a[tuple(slice(o, o + k) for o, k in zip(at, c, strict=True))]
        block[tuple(slice(0, n) for n in part.shape)] = part
        yield at, block.tobytes()


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("h5") / "a.h5")
    big = np.arange(100 * 97, dtype="<i4").reshape(100, 97)
    with h5.created(path) as w:
        w.group("/g")
        w.group("/g/h")
        w.annotate("/g", w.attribute("about", DataType("vlen_string", 16), (), ["group"]))
        w.dataset("/g/flat", I32, (20, 30), np.arange(600), [w.attribute("unit", DataType("vlen_string", 16), (), ["m"]), w.attribute("n", type_named("float64"), (3,), [1.5, 2, 3])])
        w.chunked("/g/h/c", I32, (100, 97), (7, 5), chunks(big, (7, 5)), [Filter("shuffle", 4), Filter("deflate", 6), Filter("fletcher32")], (None, 97))
        w.chunked("/holes", I32, (30, 4), (10, 4), list(chunks(np.arange(120, dtype="<i4").reshape(30, 4), (10, 4)))[::2])
        w.dataset("/record", RECORD, (2,), [{"Serial number": 5, "place": "ab", "t": 1.5}, {"Serial number": -6, "place": "Exterior", "t": 2.5}])
        w.dataset("/ragged", DataType("vlen", 16, base=I32), (2,), [[3, 2, 1], [1, 1, 2, 3, 5]])
        w.dataset("/bytes", DataType("vlen", 16, base=type_named("uint8")), (2,), [b"", b"\0\1"])
        w.dataset("/texts", DataType("vlen_string", 16), (3,), ["a", "", "déf"])
        w.dataset("/enum", DataType("enum", 2, base=type_named("int16"), members=(("A", 0), ("B", 7))), (3,), [0, 7, 0])
        w.dataset("/array", DataType("array", 24, base=type_named("int64"), dims=(3,)), (2,), [[1, 2, 3], [4, 5, 6]])
        w.dataset("/opaque", DataType("opaque", 4, tag="tag"), (2,), [b"abcd", b"ef"])
        for width in ("int8", "uint16", "uint64", "float32"):
            w.dataset(f"/{width}", type_named(width), (3,), [1, 2, 100])
        w.dataset("/null", I32, None, None)
        w.dataset("/scalar", I32, (), [42])
        w.committed_type("/type", RECORD)
        w.link("/soft", "soft", "/g/flat")
        w.link("/far", "external", "other.h5\0/x")
    return path


def values(spark, file, name):
    return [r.v for r in h5.cells(spark, file, name).orderBy("i0").collect()]


def test_catalog(spark, file):
    rows = {r.path: r for r in h5.objects(spark, file).collect()}
    assert {p: r.kind for p, r in rows.items() if r.kind != "dataset"} == {"/": "group", "/g/": "group", "/g/h/": "group", "/type": "datatype", "/soft": "soft", "/far": "external"}
    c = rows["/g/h/c"]
    assert (c.type, c.dims, c.maxdims, c.layout, c.chunk, c.filters) == ("int32", [100, 97], [None, 97], "chunked", [7, 5], ["shuffle", "deflate", "fletcher32"])
    assert rows["/soft"].target == "/g/flat" and rows["/null"].dims is None and rows["/scalar"].dims == []
    got = {(r.path, r.name): (r.type, r.value) for r in h5.attributes(spark, file).collect()}
    assert got == {("/g/", "about"): ("vlen_string", '"group"'), ("/g/flat", "unit"): ("vlen_string", '"m"'), ("/g/flat", "n"): ("float64", "[1.5, 2.0, 3.0]")}


def test_values(spark, file):
    record = values(spark, file, "/record")
    assert (record[1]["Serial number"], record[1].place, record[1].t) == (-6, "Exterior", 2.5)
    assert values(spark, file, "/ragged") == [[3, 2, 1], [1, 1, 2, 3, 5]]
    assert [bytes(v) for v in values(spark, file, "/bytes")] == [b"", b"\0\1"]
    assert values(spark, file, "/texts") == ["a", "", "déf"]
    assert values(spark, file, "/enum") == [0, 7, 0]
    assert values(spark, file, "/array") == [[1, 2, 3], [4, 5, 6]]
    assert [bytes(v) for v in values(spark, file, "/opaque")] == [b"abcd", b"ef\0\0"]
    for width in ("int8", "uint16", "uint64", "float32"):
        assert values(spark, file, f"/{width}") == [1, 2, 100]
    assert h5.cells(spark, file, "/null").count() == 0
    assert [r.v for r in h5.cells(spark, file, "/scalar").collect()] == [42]


@pytest.mark.parametrize("name,width", [("/g/h/c", 97), ("/g/flat", 30)])
def test_selections(spark, file, name, width):
    slab = Hyperslab((1, 2), (6, 5), (3, 4), (2, 5))
    got = sorted((r.i0, r.i1, r.v) for r in h5.cells(spark, file, name, slab).collect())
    rows, columns = [1 + 3 * k + b for k in range(6) for b in range(2)], [2 + 4 * k + b for k in range(5) for b in range(5)]
    assert got == sorted((i, j, i * width + j) for i in rows for j in columns)
    assert h5.cells(spark, file, name).count() == (9700 if width == 97 else 600)


def test_missing_chunks_are_zero(spark, file):
    got = {(r.i0, r.i1): r.v for r in h5.cells(spark, file, "/holes").collect()}
    assert got == {(i, j): 0 if 10 <= i < 20 else 4 * i + j for i in range(30) for j in range(4)}


def test_a_selection_reads_its_chunks_only(file):
    reader = h5.CellReader({"path": file, "dataset": "/g/h/c", "start": "0,0", "count": "8,5"})
    assert [[p.offset for p in part.of] for part in reader.partitions()] == [[(0, 0), (7, 0)]]


def test_damage(file):
    data = open(file, "rb").read()
    for bad in (b"", b"nothing", data[:40], data[:13] + b"\xff" + data[14:]):
        with pytest.raises(FormatError):
            H5File.of(bad)
    with pytest.raises(FormatError):
        f = H5File.of(data[: len(data) // 2] + bytes(len(data) - len(data) // 2))
        list(f.walk())
    f = H5File.of(bytes(512) + data)
    assert f.values(f.find("/g/flat"))[599] == 599
    with pytest.raises(KeyError):
        f.find("/no")


def test_old_structures():
    """A version 0 superblock, version 1 headers with a continuation, and a symbol table with a soft link."""
    u = lambda v, n: v.to_bytes(n, "little")
    message = lambda k, d: u(k, 2) + u(-(-len(d) // 8) * 8, 2) + bytes(4) + d + bytes(-len(d) % 8)
    header = lambda *m: b"\1\0" + u(len(m), 2) + u(1, 4) + u(sum(map(len, m)), 4) + bytes(4) + b"".join(m)
    out = bytearray(2048)

    def put(at, data):
        out[at : at + len(data)] = data

    put(0, b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + u(4, 2) + u(16, 2) + bytes(4) + u(0, 8) + u((1 << 64) - 1, 8) + u(2048, 8) + u((1 << 64) - 1, 8) + u(0, 8) + u(96, 8) + u(1, 4) + bytes(20))
    put(96, header(message(0x11, u(200, 8) + u(600, 8))))
    put(200, b"TREE\0\0" + u(1, 2) + b"\xff" * 16 + u(0, 8) + u(400, 8) + u(8, 8))
    put(400, b"SNOD\1\0" + u(2, 2) + u(8, 8) + u(800, 8) + bytes(24) + u(16, 8) + u(0, 8) + u(2, 4) + bytes(4) + u(24, 4) + bytes(12))
    put(600, b"HEAP\0\0\0\0" + u(64, 8) + u(0, 8) + u(700, 8))
    put(700, bytes(8) + b"data".ljust(8, b"\0") + b"soft".ljust(8, b"\0") + b"/data\0")
    more = message(3, bytes([0x10, 9, 0, 0]) + u(2, 4) + u(0, 2) + u(16, 2)) + message(8, bytes([3, 1]) + u(1200, 8) + u(6, 8))
    put(800, header(message(1, bytes([1, 1, 0, 0, 0, 0, 0, 0]) + u(3, 8)), message(0x10, u(1000, 8) + u(len(more), 8))))
    put(1000, more)
    put(1200, np.array([-1, 2, 300], ">i2").tobytes())
    f = H5File.of(bytes(out))
    assert [(p, k) for p, k, _ in f.walk()] == [("/", "group"), ("/data", "dataset"), ("/soft", "soft")]
    assert f.values(f.find("/soft")).tolist() == [-1, 2, 300] and f.type_of(f.find("/data")).big


def test_dense_links():
    """A group whose links lie in a fractal heap of two direct blocks, named by an index of two levels."""
    u = lambda v, n: v.to_bytes(n, "little")
    out, none = bytearray(8192), (1 << 64) - 1

    def put(at, data):
        out[at : at + len(data)] = data

    def header(*messages):
        body = b"".join(bytes([k]) + u(len(d), 2) + b"\0" + d for k, d in messages)
        whole = b"OHDR" + bytes([2, 0, len(body)]) + body
        return whole + u(lookup3(whole), 4)

    link = lambda name, to: bytes([1, 0, len(name)]) + name + u(to, 8)
    head = b"\x89HDF\r\n\x1a\n" + bytes([3, 8, 8, 0]) + u(0, 8) + u(none, 8) + u(8192, 8) + u(48, 8)
    put(0, head + u(lookup3(head), 4))
    put(48, header((2, bytes([0, 0]) + u(200, 8) + u(600, 8))))
    # Blocks of 512 bytes, two a row; offsets in the heap have 4 bytes and lengths 2.
    put(200, b"FRHP" + bytes([0]) + u(7, 2) + u(0, 2) + b"\0" + u(512, 4) + u(0, 8) + u(none, 8) + u(0, 8) + u(none, 8) + bytes(64) + u(2, 2) + u(512, 8) + u(1024, 8) + u(32, 2) + u(1, 2) + u(1000, 8) + u(2, 2))
    put(1000, b"FHIB\0" + u(200, 8) + u(0, 4) + u(2048, 8) + u(none, 8) + u(3072, 8) + u(none, 8))
    links = [link(b"a", 5000), link(b"b", 5200), link(b"c", 5000)]
    block = lambda at: b"FHDB\0" + u(200, 8) + u(at, 4)
    put(2048, block(0) + links[0] + links[1])
    put(3072, block(1024) + links[2])
    places = [(17, len(links[0])), (17 + len(links[0]), len(links[1])), (1024 + 17, len(links[2]))]
    records = [u(7, 4) + b"\0" + u(at, 4) + u(n, 2) for at, n in places]
    put(600, b"BTHD\0\5" + u(512, 4) + u(11, 2) + u(1, 2) + bytes([100, 40]) + u(700, 8) + u(1, 2) + u(3, 8))
    put(700, b"BTIN\0\5" + records[1] + u(800, 8) + u(1, 1) + u(900, 8) + u(1, 1))
    put(800, b"BTLF\0\5" + records[0])
    put(900, b"BTLF\0\5" + records[2])
    space = bytes([2, 0, 0, 0])
    put(5000, header((1, space), (3, bytes([0x10, 8, 0, 0]) + u(4, 4) + u(0, 2) + u(32, 2)), (8, bytes([3, 0]) + u(4, 2) + u(41, 4))))
    put(5200, header((0x0A, bytes([0, 0])), (2, bytes([0, 0]) + u(none, 8) * 2)))
    f = H5File.of(bytes(out))
    assert [(p, k) for p, k, _ in f.walk()] == [("/", "group"), ("/a", "dataset"), ("/b/", "group"), ("/c", "dataset")]
    assert f.values(f.find("/c")).tolist() == [41]


@pytest.mark.parametrize(("limit", "most", "name"), [("MAX_CHUNK", 7 * 5 * 4, "/g/h/c"), ("MAX_DATASET", 600 * 4, "/g/flat"), ("MAX_STRING", 8, "/record"), ("MAX_STRING", 4, "/texts")])
def test_a_file_cannot_ask_for_any_buffer(file, monkeypatch, limit, most, name):
    """What is just within a limit is read; a byte less is refused."""
    from latticework.sources import h5format

    data = open(file, "rb").read()
    monkeypatch.setattr(h5format, limit, most)
    f = H5File.of(data)
    assert len(f.values(f.find(name)))
    monkeypatch.setattr(h5format, limit, most - 1)
    with pytest.raises(FormatError, match="at most"):
        f.values(f.find(name))


def test_an_attribute_cannot_be_any_size(file, monkeypatch):
    from latticework.sources import h5format

    f = H5File.of(open(file, "rb").read())
    node = f.find("/g/flat")
    assert {a[0] for a in f.attributes(node)} == {"unit", "n"}
    monkeypatch.setattr(h5format, "MAX_ATTRIBUTE", 23)
    with pytest.raises(FormatError, match="an attribute"):
        list(f.attributes(node))
