import bz2
import datetime as dt
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from latticework.operators import arrays, catalog, codecs, workload
from latticework.operators.codecs import Filter, FilterError
from latticework.plans.ranges import key_ranges
from latticework.plans.selection import Hyperslab, select
from latticework.sources.container import Container, attribute_type
from latticework.sources.dumps import hexdump, parse_dump, read_dumps
from latticework.streaming.workload import drained, steady_modes, windowed_features

T0 = dt.datetime(2024, 1, 1)


def test_codecs_round_trip():
    for n in (0, 1, 4, 400, 4096):
        for data in (os.urandom(n), bytes(n), b"abcd" * (n // 4)):
            data = data[: len(data) // 4 * 4]
            for filters in ([Filter("deflate", 6)], [Filter("lzf", len(data))], codecs.pipeline([Filter("deflate"), Filter("fletcher32"), Filter("shuffle", 4)])):
                assert codecs.remove_filters(codecs.apply_filters(data, filters), filters) == data


def test_filters_that_fail():
    with pytest.raises(FilterError):
        codecs.remove_filters(b"abcd\0\0\0\1", [Filter("fletcher32")])
    with pytest.raises(zlib.error):
        codecs.remove_filters(b"abcd", [Filter("deflate")])
    assert codecs.remove_filters(b"abcd", [Filter("deflate", optional=True)]) == b"abcd"
    assert codecs.remove_filters(b"abcd", [Filter("deflate")], mask=1) == b"abcd"
    assert codecs.remove_filters(bz2.compress(b"x"), [Filter("bzip2")]) == b"x"
    for name in ("bzip2", "szip"):
        with pytest.raises(FilterError):
            codecs.apply_filters(b"x", [Filter(name)])
    with pytest.raises(FilterError):
        codecs.shuffle(b"abc", 2)
    assert codecs.shuffle(b"abcd", 2) == b"acbd"


def test_codec_columns(spark):
    df = spark.createDataFrame([(b"abcd" * 9,), (None,), (b"",)], "d binary")
    f = [Filter("deflate"), Filter("fletcher32")]
    rows = df.select("d", codecs.decoded(codecs.encoded(F.col("d"), f), f).alias("b")).collect()
    assert all(r.d == r.b for r in rows)


def ops(*kinds, step=1.0, size=1024):
    return [("k", k, T0 + dt.timedelta(seconds=i * step), size * (i + 1), i) for i, k in enumerate(kinds)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, op string, ts timestamp_ntz, size long, seq long")


def test_features(spark):
    f = workload.features(frame(spark, ops(*["delete"] * 6, *["write"] * 3, "read")), ["key"]).first()
    assert (f.n, f.size, f.burst) == (10, 10240, True)
    assert [round(x, 6) for x in (f.delete_ratio, f.write_ratio, f.read_ratio, f.rate)] == [0.6, 0.3, 0.1, round(10 / 9, 6)]


@pytest.mark.parametrize(
    "kinds,step,want",
    [
        (["delete"] * 8 + ["write"] * 2, 1, "BatchDeletion"),
        (["write"] * 7 + ["delete"] * 1 + ["read"] * 2, 10, "FrequentWrites"),
        (["write"] * 8 + ["read"] * 2, 10, "AppendOnly"),
        (["read"] * 8 + ["write"] * 1 + ["delete"] * 1, 10, "ReadHeavy"),
        (["read"] * 5 + ["write"] * 4 + ["delete"] * 1, 10, "MixedRW"),
        (["read"] * 5, 1, "Unknown"),
        (["delete"] * 5 + ["read"] * 5, 10, "Unknown"),
    ],
)
def test_classes(spark, kinds, step, want):
    assert workload.decide(workload.features(frame(spark, ops(*kinds, step=step)), ["key"])).first().workload == want


def test_trailing_window_expires(spark):
    late = [("k", "write", T0 + dt.timedelta(minutes=2, seconds=i), 1, 100 + i) for i in range(3)]
    rows = workload.trailing(frame(spark, ops(*["delete"] * 5) + late), ["key"], 60).orderBy(F.desc("seq")).collect()
    assert (rows[0].n, rows[0].write_ratio) == (3, 1.0)


def test_gates(spark):
    rows = spark.createDataFrame([(2000, 0.0, 0.9, 0.1, True, 600 << 20), (20, 0.0, 0.9, 0.1, False, 1), (200, 0.1, 0.4, 0.5, False, 600 << 20)], "n long, delete_ratio double, write_ratio double, read_ratio double, burst boolean, size long")
    got = workload.decide(rows).select("workload", "confidence", "fit", "safe").collect()
    assert [tuple(r) for r in got] == [("AppendOnly", 1.0, "none", "none"), ("AppendOnly", 0.6, "none", "none"), ("MixedRW", 0.75, "incremental", "incremental")]
    assert workload.decide(rows, allowed=("none", "lazy")).collect()[2].safe == "none"


def test_stability():
    s = 1_000_000
    rows = [(0, "lazy", False), (10 * s, "incremental", False), (15 * s, "none", True), (31 * s, "incremental", False), (40 * s, "incremental", False), (65 * s, "lazy", False), (71 * s, "lazy", False)]
    assert [m for m, _ in workload.steady(iter(rows))] == ["lazy", "lazy", "none", "incremental", "incremental", "incremental", "lazy"]


def test_stream_equals_batch(spark, tmp_path):
    kinds = ["read"] * 60 + ["write"] * 60 + ["delete"] * 5
    rows = frame(spark, [(k, o, T0 + dt.timedelta(minutes=7 * i), 700 << 20, i) for k in ("a", "b") for i, o in enumerate(kinds)])
    rows.write.parquet(str(tmp_path / "in/1"))
    frame(spark, [("end", "read", T0 + dt.timedelta(days=99), 0, -1)]).write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in/*"))
    got = drained(windowed_features(stream)).where("key <> 'end'").drop("ts")
    want = windowed_features(rows).drop("ts")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_steady_stream_equals_batch(spark, tmp_path):
    rows = [("k", T0 + dt.timedelta(seconds=s), m, m, 0.9) for s, m in ((0, "lazy"), (10, "none"), (31, "none"), (50, "lazy"), (70, "lazy"))]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, fit string, safe string, confidence double")
    df.write.parquet(str(tmp_path / "d"))
    got = drained(steady_modes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "d"))))
    want = workload.hysteresis(df, "key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r.kept for r in want.orderBy("us").collect()] == ["lazy", "lazy", "none", "none", "lazy"]


def test_hysteresis_keeps_its_state_over_batches(spark):
    """Many keys, null ones too, in batches of three rows, against the rule on each key's list."""
    rng = random.Random(8)
    rows = [(k, T0 + dt.timedelta(seconds=11 * i), m, m, c) for k in (None, 1, 2, 3) for i in range(25) for m, c in [(rng.choice(["lazy", "none", "incremental"]), rng.choice([0.5, 0.9, 0.9]))]]
    df = spark.createDataFrame(rows, "key int, ts timestamp_ntz, fit string, safe string, confidence double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = [(r.key, r.us, r.kept) for r in workload.hysteresis(df, "key").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = []
    for key in (None, 1, 2, 3):
        mine = [(int((r[1] - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000, r[3], r[4] < 0.7) for r in rows if r[0] == key]
        want += [(key, m[0], kept) for m, (kept, _) in zip(mine, workload.steady(iter(mine)), strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_loop(spark, tmp_path):
    from latticework.streaming.workload import start_loop

    spark.range(5).write.parquet(str(tmp_path / "d"))
    seen = []
    query = start_loop(spark.readStream.schema("id long").parquet(str(tmp_path / "d")), lambda batch, n: seen.append(batch.count()), str(tmp_path / "c"), "1 second")
    query.processAllAvailable()
    query.stop()
    assert sum(seen) == 5


def test_container(spark, tmp_path):
    box = Container.create(spark, str(tmp_path / "c"))
    box.add_group("/g")
    cells = spark.range(20 * 30).selectExpr("id div 30 AS i", "id % 30 AS j", "double(id) AS v")
    box.write_dataset("/g/d", cells, "float64", (20, 30), ("i", "j"), chunk=(10, 10), maxdims=(None, 30))
    box.add_link("/g/same", "hard", "/g/d")
    box.add_link("/soft", "soft", "/nowhere")
    box.add_link("/far", "external", "/x", "other.lw")
    box.set_attribute("/g/d", "unit", "m")
    box.set_attribute("/g/d", "unit", ["a", "b"])
    box.set_attribute("/g/d", "n", 3)
    box.delete_attribute("/g/d", "n")
    box = Container(spark, str(tmp_path / "c"))
    assert [r.walk_path for r in box.walk().orderBy("walk_key").collect()] == ["/", "/g/", "/g/d", "/g/same"]
    assert box.attribute("/g/d", "unit") == ["a", "b"] and box.attributes.count() == 1
    got = box.select("/g/d", Hyperslab((1, 2), (4, 3), (5, 10)), ("i", "j"))
    assert sorted(r.v for r in got.collect()) == [30.0 * i + j for i in (1, 6, 11, 16) for j in (2, 12, 22)]
    box.add_linked_group("/many", {f"d{i}": "/g/d" for i in range(12)})
    assert catalog.reference_counts(box.objects, box.links).where("refs = 14").count() == 1
    steps = []
    chunks = box.chunks("/g/d", ("i", "j"))
    chunks.on_progress = lambda done, total: steps.append((done, total))
    seen = {at: (rows.count(), rows.agg(F.min("v")).first()[0]) for at, rows in chunks}
    assert seen == {(a, b): (100, 300.0 * a + 10 * b) for a in range(2) for b in range(3)}
    assert steps[-1] == (6, 6) and chunks.progress == 1.0 and list(chunks) == []
    chunks.reset()
    assert next(iter(chunks))[0] == (0, 0) and chunks.extents((1, 2)) == (10, 10)
    with pytest.raises(InterruptedError):
        list(box.chunks("/g/d", ("i", "j"), lambda: True))
    assert box.info().first().info == "float64, 2D array [20 x 30], chunked [10 10]"
    box.resize("/g/d", (40, 30))
    box.compact("/g/d")
    grown = box.cells("/g/d")
    assert grown.count() == 1200 and grown.where("v <> 0").count() == 599
    assert box.cells("/g/same").count() == 1200 and box.attribute("/g/same", "unit") == ["a", "b"]
    assert [r.v for r in box.select("/g/same", Hyperslab((19, 29), (2, 1)), ("i", "j")).orderBy("i").collect()] == [599.0, 0.0]
    for bad in (lambda: box.add_group("/no/way"), lambda: box.add_group("/g"), lambda: box.add_group("g"), lambda: box.add_link("/z", "hard", "/nowhere"), lambda: box.add_link("/z", "external", "/x", "../y"), lambda: box.resize("/g/d", (4, 31))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        box.delete_attribute("/g/d", "n")
    with pytest.raises(ValueError):
        box.write_dataset("/g/e", cells, "float64", (20, 30), ("i", "j"), chunk=(10, 40))
    assert catalog.dangling(box.objects, box.links).count() == 1


def test_a_shrunk_dataset_has_lost_its_cells(spark, tmp_path):
    box = Container.create(spark, str(tmp_path / "c"))
    box.write_dataset("/d", spark.range(10).selectExpr("id AS i", "id + 1 AS v"), "int64", (10,), ("i",), chunk=(4,), maxdims=(None,))
    for n, kept in ((4, 4), (12, 4), (3, 3), (5, 3)):
        box.resize("/d", (n,))
        assert [r.v for r in Container(spark, str(tmp_path / "c")).cells("/d").orderBy("i").collect()] == [i + 1 if i < kept else 0 for i in range(n)]
    box.compact("/d")
    assert [r.v for r in box.select("/d", Hyperslab((1,), (4,)), ("i",)).orderBy("i").collect()] == [2, 3, 0, 0]


def test_wrong_cells_leave_no_dataset(spark, tmp_path):
    box = Container.create(spark, str(tmp_path / "c"))
    for rows in ("range(3)", "(SELECT 0 AS id UNION ALL SELECT id FROM range(9))", "range(11)", "range(1, 11)"):
        with pytest.raises(ValueError, match="each place once"):
            box.write_dataset("/d", spark.sql(f"SELECT id AS i, id AS v FROM {rows}"), "int64", (10,), ("i",))
    with pytest.raises(Exception):
        box.write_dataset("/d", spark.range(10).selectExpr("id AS i", "raise_error('no') AS v"), "int64", (10,), ("i",))
    assert box.objects.count() == 1 and Container(spark, str(tmp_path / "c")).objects.count() == 1


def test_paths_lead_through_links(spark, tmp_path):
    other = Container.create(spark, str(tmp_path / "other"))
    other.write_dataset("/x", spark.range(3).selectExpr("id AS i", "id AS v"), "int64", (3,), ("i",))
    box = Container.create(spark, str(tmp_path / "c"))
    box.add_group("/g")
    box.write_dataset("/g/d", spark.range(5).selectExpr("id AS i", "id AS v"), "int64", (5,), ("i",))
    box.set_attribute("/g", "of", 1)
    for path, kind, to, file in (("/h", "hard", "/g", None), ("/s", "soft", "/t", None), ("/t", "soft", "/h/d", None), ("/e", "external", "/x", "other"), ("/loop", "soft", "/pool", None), ("/pool", "soft", "/loop", None), ("/lost", "soft", "/no", None)):
        box.add_link(path, kind, to, file)
    assert [box.cells(p).count() for p in ("/g/d", "/h/d", "/s", "/t", "/e")] == [5, 5, 5, 5, 3]
    assert box.attribute("/h", "of") == 1
    with pytest.raises(KeyError):
        box.cells("/lost")
    with pytest.raises(ValueError, match="links"):
        box.cells("/loop")


def test_two_writers_at_once(spark, tmp_path):
    one = Container.create(spark, str(tmp_path / "c"))
    two = Container(spark, str(tmp_path / "c"))
    one.add_group("/a")
    with pytest.raises(RuntimeError, match="another writer"):
        two.add_group("/b")


def test_a_walk_is_depth_first_in_the_order_of_bytes(spark):
    paths = ["/", "/run", "/run/x", "/run.1", "/run-2", "/run 3", "/run/x.y", "/run/x/a", "/a", "/Z", "/é", "/run0"]
    objects = spark.createDataFrame([(p, "group", i, "", "") for i, p in enumerate(paths)], "path string, kind string, object_id long, parent string, name string")
    want = sorted(paths, key=lambda p: p.rstrip("/").encode().split(b"/"))
    assert [r.path for r in catalog.walk(objects).orderBy("walk_key").collect()] == want
    assert {r.path: r.place for r in catalog.walk_ordinals(objects).collect()} == {p: k for k, p in enumerate(want)}


def test_attribute_types():
    assert [attribute_type(v) for v in (1, 1.5, "a", [1, 2], ["x"])] == ["int64", "float64", "string", "array:int64", "array:string"]
    for bad in (True, None, [], [1, "a"], {}):
        with pytest.raises(TypeError):
            attribute_type(bad)


#: A dump of an array of our own, in which element i is 7 i.
DUMP = """HDF5 "own.h5" {
GROUP "/" {
   DATASET "sevens" {
      DATATYPE  H5T_STD_I32LE
      DATASPACE  SIMPLE { ( 40 ) / ( 40 ) }
      SUBSET {
         START ( 2 );
         STRIDE ( 12 );
         COUNT ( 3 );
         BLOCK ( 2 );
         DATA {
         (2): 14, 21, 98, 105,
         (26): 182, 189
         }
      }
   }
   DATASET "texts" {
      DATATYPE  H5T_STRING
      DATASPACE  SIMPLE { ( 2 ) / ( 2 ) }
      DATA {
      (0): "a b", "c"
      }
   }
   DATASET "none" { DATATYPE H5T_STD_I64BE DATASPACE NULL DATA { } }
}
}
"""


def test_dumps(spark, tmp_path):
    one, text, null = parse_dump(DUMP)
    assert one["dims"] == [40] and one["selection"]["block"] == [2] and one["values"] == [14, 21, 98, 105, 182, 189]
    assert text["values"] == ["a b", "c"] and null["dims"] is None
    (tmp_path / "a.ddl").write_text(DUMP)
    assert [r.value for r in read_dumps(spark, str(tmp_path)).orderBy("n").collect()] == [14, 21, 98, 105, 182, 189]


def test_a_selection_gives_the_values_of_a_dump(spark):
    """What select() reads of the array is what the dump shows, in its order."""
    one = parse_dump(DUMP)[0]
    at = one["selection"]
    cells = spark.range(one["dims"][0]).selectExpr("id AS i", "id * 7 AS v")
    got = select(cells, Hyperslab(*(at[k] for k in ("start", "count", "stride", "block"))), ("i",), one["dims"], ordinals=True)
    assert [r.v for r in got.orderBy("o0").collect()] == one["values"]


def test_trailing_capacity_equals_a_deque(spark):
    rng, rows = random.Random(4), []
    for seq in range(400):
        rows.append(("ab"[seq % 2], rng.choice(["read", "write", "delete"]), T0 + dt.timedelta(seconds=rng.randint(0, 300)), 1, seq))
    for capacity in (1, 7, 50, 1000):
        got = {r.seq: (r.n, r.n_delete) for r in workload.trailing(frame(spark, rows), ["key"], 60, capacity).collect()}
        want = {}
        for key in "ab":
            held = []
            for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[4])):
                held = [*held, r][-capacity:]
                now = [h for h in held if h[2] >= r[2] - dt.timedelta(seconds=60)]
                want[r[4]] = (len(now), sum(h[1] == "delete" for h in now))
        assert got == want


def test_fletcher_is_linear(spark):
    from latticework.functions.checksums import fletcher32

    data = [b"", b"a", b"ab", bytes(range(256)) * 3 + b"x", b"\xff" * 64_000]
    df = spark.createDataFrame([(d,) for d in data], "d binary")
    for r in df.select("d", fletcher32(F.col("d")).alias("f")).collect():
        assert r.f == (codecs.fletcher(bytes(r.d)) if r.d else 0)


LONG = (1 << 63) - 1


@pytest.mark.parametrize("keys", [[-LONG - 1, 5, LONG], [*range(1500), 9 * 10**18], [b + k for b in (0, 10**12, -(10**15)) for k in range(500)], []])
def test_positions_of_any_keys(spark, keys):
    df = spark.createDataFrame([(k,) for k in [*keys[::-1], None]], "k long")
    got = {r.k: r.i for r in arrays.positions(df, "k", rows=64).collect()}
    assert got.pop(None) is None and got == {k: i for i, k in enumerate(sorted(keys))}
    near = df.where("k IS NOT NULL").groupBy(key_ranges(df, "k").range_of(F.col("k"), 64)).count()
    assert all(r["count"] <= 3 * 64 for r in near.collect())


def test_a_key_with_many_rows_is_split(spark):
    rows = [(7, i / 2000) for i in range(2000)] + [(k, 0.5) for k in range(2000)]
    df = spark.createDataFrame(rows, "k long, s double")
    near = df.withColumn("r", key_ranges(df, "k").range_of(F.col("k"), 64, F.col("s")))
    got = sorted((r.k, -r.s, r.r) for r in near.collect())
    assert [r[2] for r in got] == sorted(r[2] for r in got)
    assert near.groupBy("r").count().agg(F.max("count")).first()[0] <= 3 * 64


def test_hexdump(spark):
    df = spark.createDataFrame([("f", bytes(range(40, 80)))], "path string, content binary")
    rows = hexdump(df, 4, 20).orderBy("at").collect()
    assert [r["at"] for r in rows] == [4, 20] and rows[1].hex == "3c 3d 3e 3f" and rows[1].ascii == "<=>?"
