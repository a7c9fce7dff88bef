import base64
import hashlib
import math
import re
import struct
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from latticework.llm import bpe, common, fingerprints, langid, line_dedup, mixing, ogg, queries, sharding, simhash, unigram, warc
from latticework.llm.components import components

from .. import oracle
from .conftest import DOCS

BLANKS = " \t\n\x0b\f\r"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words_of(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.skipif(not oracle.HAVE, reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    oracle.same(spark, queries.QUERIES[name], queries.SQL[name])


# 1


def order(rows):
    """Descending ids; nulls last, by the hash that the operator names."""
    key = lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 32, r[1] or "")
    return sorted(rows, key=key)


def shingles(text, k=5):
    w = words_of(text)
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_fingerprints(spark, rows, folder):
    got = Counter(tuple(r)[:3] for r in fingerprints.op1_fingerprints(spark, folder).collect())
    ordered, want, near = order(rows), Counter(), defaultdict(list)
    for i, r in enumerate(ordered):
        text, follow = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follow[:half]
        want[(r[0], len(text), sha(edited))] += 1
        near[(r[0], sha(edited))].append((text, edited, follow))
    assert got == want
    prints = {}
    for r in fingerprints.op1_fingerprints(spark, folder).collect():
        fits = []
        for text, edited, follow in near[(r.doc_id, r.edited_sha256)]:
            assert len(r.fingerprint) == 512 and prints.setdefault(text, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
            a, b, c = shingles(text), shingles(edited), shingles(follow)
            true = [len(a & x) / len(a | x) if a | x else 1.0 for x in (b, c)]
            fits.append(all(0 <= got <= 1 and abs(got - want) < 0.17 for got, want in zip((r.near_edited, r.near_next), true, strict=True)))
            assert text != edited or r.near_edited == 1.0
        assert any(fits)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_xxhash64(*values):
    """Spark's hash of texts and longs: XXH64 of each, seeded by the one before; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h


def spark_hash(*values):
    """Spark's hash of ints: 32-bit Murmur 3, seeded by the one before, signed."""
    m, rot, h = 0xFFFFFFFF, lambda x, k: (x << k | x >> 32 - k) & 0xFFFFFFFF, 42
    for v in values:
        k = rot((v & m) * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
        h ^= 4
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> shift) * by & m
    return h - (1 << 32) if h >> 31 else h


def plain_fingerprint(text, bins=256, probes=fingerprints.PROBES):
    """Bins' least hashes, empty ones filled along their probes, two digits of each."""
    words = words_of(text)
    if not words:
        return "00" * bins
    h = [signed(spark_xxhash64(w)) for w in words]
    least = {}
    for i in range(max(1, len(h) - 4)):
        x = signed(spark_xxhash64(*h[i : i + 5]))
        b = (x >> 56) + 128
        least[b] = min(least.get(b, 1 << 80), x)
    out = []
    for b in range(bins):
        for a in range(probes):
            if b in least:
                break
            b0 = spark_hash(len(out), a) & bins - 1
            if b0 in least:
                b = b0
        if b not in least:
            b = min(least, key=lambda j: (spark_hash(len(out), j, probes), j))
        out.append(f"{least[b] & 255:02x}")
    return "".join(out)


def test_fingerprints_bit_for_bit(spark, rows, folder):
    texts = {r[1] or "" for r in rows} | {"one", "a b c d", "a b c d e f", " ".join(f"w{i}" for i in range(9000))}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.f for r in df.select("t", fingerprints.fingerprint(F.col("t")).alias("f")).collect()}
    assert got == {t: plain_fingerprint(t) for t in texts}


TOP = (1 << 63) - 1


@pytest.mark.parametrize("ids", [[-9 * 10**18, 5, 9 * 10**18], [-TOP - 1, -TOP, 0, TOP - 1, TOP], [*range(700), TOP], [None] * 30, [None, 3, None], [4] * 40 + [5, 6]])
def test_next_document_for_any_ids(spark, ids):
    docs = [(i, f"text {k} of {i}") for k, i in enumerate(ids)]
    got = Counter((r.k, r.t, r.next.t) for r in fingerprints.cyclic_next(spark.createDataFrame(docs, "k long, t string"), "k", ["t"], "t").collect())
    down = order(docs)
    assert got == Counter((*d, down[(i + 1) % len(down)][1]) for i, d in enumerate(down))


def test_likeness_has_no_bias(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for true in (0.1, 0.5, 0.8, 0.95):
        for _ in range(40):
            n = int(rng.integers(60, 900))
            both = int(2 * n * true / (1 + true))
            tokens = [f"w{x}" for x in rng.integers(0, 1 << 40, 2 * n - both)]
            # Words are shingles here.
            pairs.append((true, " ".join(tokens[:n]), " ".join(tokens[n - both :])))
    df = spark.createDataFrame(pairs, "t double, a string, b string")
    near = fingerprints.likeness(fingerprints.fingerprint(F.col("a"), 256, 8, 1), fingerprints.fingerprint(F.col("b"), 256, 8, 1))
    low = fingerprints.likeness(fingerprints.fingerprint(F.col("a"), 256, 4, 1), fingerprints.fingerprint(F.col("b"), 256, 4, 1), bits=4)
    for r in df.select("t", near.alias("n"), low.alias("l")).groupBy("t").agg(F.avg("n").alias("n"), F.avg("l").alias("l")).collect():
        assert abs(r.n - r.t) < 0.03 and abs(r.l - r.t) < 0.03


def test_cyclic_next_over_far_ranges(spark):
    keys = [5, 6, 7, 10_000, 10_001, 2_000_000, 2_000_001, -50]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k long, t string")
    got = {r.k: r.next.k for r in fingerprints.cyclic_next(df, "k", ["k"], "t").collect()}
    down = sorted(keys, reverse=True)
    assert got == {k: down[(i + 1) % len(down)] for i, k in enumerate(down)}


# 2


def plain_targets(sizes, share=1.5, epochs=2):
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    fixed = {}
    while True:
        left = share * sum(sizes) - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        want = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if want[i] > epochs * sizes[i] + 1e-9]
        if not over:
            return [fixed.get(i, want.get(i)) for i in range(len(sizes))]
        fixed |= {i: epochs * sizes[i] for i in over}


def test_mixing(spark, rows, folder):
    got = mixing.op2_mixing(spark, folder).collect()
    again = mixing.op2_mixing(spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words_of(r[1])) for r in rows if r[3] == s) for s in names]
    targets = dict(zip(names, plain_targets(sizes), strict=True))
    by_size = dict(zip(names, sizes, strict=True))
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == Counter((r[0], len(words_of(r[1])), by_size[r[3]], round(targets[r[3]], 6)) for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[(r.source_size, r.target)] += r.taken
    assert all(abs(n - t) <= 0.5 for (_, t), n in taken.items())


def test_each_document_gets_what_its_slots_take(spark, folder, rows):
    """The mix word by word: each source's documents in the order of their hashes, read again and again until its slots are full."""
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(words_of(r[1])) for r in rows if r[3] == s) for s in names]
    want = Counter()
    pieces = common.power_of_two(len(rows) / mixing.PIECE_ROWS, mixing.MAX_PIECES)
    assert pieces == 1
    for s, of, target in zip(names, sizes, plain_targets(sizes), strict=True):
        docs = []
        for r in rows:
            if r[3] == s:
                n, code = len(words_of(r[1])), signed(spark_xxhash64(r[1]))
                # The hash of a seed (an int), the id, the number of words and the text's hash.
                docs.append((signed(spark_ints_xxhash64(mixing.SEED, r[0], n, code)), (r[0] is not None, r[0] or 0), n, code, r[0]))
        docs.sort()
        left, taken = min(2 * of, round(target)), [0] * len(docs)
        while left:
            for k, d in enumerate(docs):
                got = min(left, d[2])
                taken[k] += got
                left -= got
        want.update((d[4], d[2], t) for d, t in zip(docs, taken, strict=True))
    assert Counter((r.doc_id, r.size, r.taken) for r in mixing.op2_mixing(spark, folder).collect()) == want


def spark_ints_xxhash64(first, *longs):
    """Spark's hash of an int (4 bytes) and then longs."""
    h = xxhash.xxh64_intdigest(first.to_bytes(4, "little", signed=True), 42)
    for v in longs:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
    return h


def test_mix_lists_sources_without_python_workers(spark, monkeypatch):
    """The sources' rows reach the executors without an RDD of Python rows, whose workers would stay; their values as they are."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("an RDD of Python rows"))
    for source in ("CASE WHEN id % 3 < 2 THEN concat('s', id % 3) END", "timestamp_seconds(1000 + id % 3)", "CAST(1 + id % 3 AS decimal(5, 2))"):
        df = spark.range(9).selectExpr("id", f"{source} AS source", "10 + id AS size")
        out = mixing.mix(df, "source", "size", ["id"]).groupBy("id", "source", "size", "source_size").agg(F.sum("words").alias("words")).collect()
        whole = {r.source: r.s for r in df.groupBy("source").agg(F.sum("size").alias("s")).collect()}
        assert sorted(r.id for r in out) == list(range(9)) and len(whole) == 3
        assert all(r.source_size == whole[r.source] for r in out) and abs(sum(r.words for r in out) - 189) <= 3


def test_mix_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], 3 + k) for k in range(12)], "id long, source string, size long")
    for name in ("place", "slot", "target", "offset", "words", "_place", "_size", "_doc", "_row", "_block", "mine"):
        df = df.withColumn(name, F.lit("mine"))
    out = mixing.mix(df, "source", "size", ["id"], block=4)
    added = {"place", "slot", "target", "words", "row", "source_size", "epoch", "first"}
    assert set(out.columns) == set(df.columns) | added and len(out.columns) == len(set(out.columns))
    for r in out.collect():
        assert all(r[c] == "mine" for c in df.columns if c not in {"id", "source", "size"} | added)
        assert r.words >= 0 and r.target > 0


def test_schedule_keeps_shares_at_every_prefix(spark):
    taken = [9000, 3000, 700, 0, 1]
    rows = mixing.schedule(spark, taken, 16).orderBy("slot").collect()
    counts, seen = [-(-t // 16) for t in taken], Counter()
    for k, r in enumerate(rows, 1):
        assert r.block == seen[r.place]
        seen[r.place] += 1
        assert r.words == min(16, taken[r.place] - 16 * r.block)
        for p, n in enumerate(counts):
            assert abs(seen[p] - k * n / sum(counts)) < 2 + math.log2(sum(counts))
    assert [seen[p] for p in range(5)] == counts


def test_ranks_have_a_closed_form(spark):
    bits = 6
    rev = lambda n: int(f"{n:06b}"[::-1], 2)
    df = spark.range(64).withColumn("point", mixing.reversed_bits(F.col("id"), bits))
    for a in (0, 1, 7, 32, 50, 64):
        for r in df.withColumn("r", mixing.rank_below(F.col("id"), F.col("point"), F.lit(a), bits)).collect():
            assert r.point == rev(r.id) and r.r == sum(rev(m) < a for m in range(r.id))


def test_many_sources_use_the_other_lookup(spark, monkeypatch):
    taken = [50 + i for i in range(30)]
    one = sorted(map(tuple, mixing.schedule(spark, taken, 8).collect()))
    monkeypatch.setattr(mixing, "TREE", 3)
    assert one == sorted(map(tuple, mixing.schedule(spark, taken, 8).collect()))


# 3


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
    return c


def test_ogg_codec():
    rng = np.random.default_rng(2)
    assert ogg.page_checksum(b"OggS page") == slow_crc(b"OggS page")
    for n in (0, 1, 192, 255, 1024, 1025, 70_000):
        for packet, streams, segments in ((1024, 2, 255), (255, 1, 3), (254, 3, 2), (600, 2, 1)):
            payload = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
            got = ogg.read_ogg(ogg.write_ogg(payload, packet, streams, segments))
            assert got["payload"] == payload and got["streams"] == streams
            assert got["times"] == [i * 1_000_000 // ogg.RATE for i in range(0, n, packet)]


def test_damaged_ogg():
    media = ogg.write_ogg(b"abc" * 5000)
    pages, at = [], 0
    while at < len(media):
        end = at + 27 + media[at + 26] + sum(media[at + 27 : at + 27 + media[at + 26]])
        pages.append(media[at:end])
        at = end
    for bad in (media[:-1], media[:100] + b"\1" + media[101:], b"".join(pages[:2] + pages[3:]), b"".join(pages[1:]), b"junk" + media):
        with pytest.raises(ValueError):
            ogg.read_ogg(bad)


CRC = [slow_crc(bytes([b])) for b in range(256)]


def plain_ogg(media):
    """Payload and description of such media, read without the module: page by page, checksums by table."""
    packets, heads, pages, at = defaultdict(list), {}, 0, 0
    while at < len(media):
        magic, _, kind, granule, serial, number, crc, n = struct.unpack("<4sBBqIIIB", media[at : at + 27])
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at : at + 22] + bytes(4) + media[at + 26 : end]
        c = 0
        for b in page:
            c = (c << 8 & 0xFFFFFFFF) ^ CRC[c >> 24 ^ b]
        assert magic == b"OggS" and c == crc
        pages, body, p = pages + 1, at + 27 + n, packets[serial]
        whole = not kind & 1
        for size in lacing:
            if whole:
                p.append([b"", None])
            p[-1][0] += media[body : body + size]
            body += size
            whole = size < 255
            if whole:
                p[-1][1], last = None, p[-1]
        if any(size < 255 for size in lacing):
            last[1] = granule
        at = end
    samples = []
    for p in packets.values():
        _, rate, size, turn, streams = struct.unpack("<4sIIII", p[0][0])
        for k, (data, granule) in enumerate(p[1:]):
            start = (k * streams + turn) * size
            # The granule position says where a page's last packet ends.
            assert granule is None or granule == start + len(data)
            samples.append((start, data))
    samples.sort()
    payload = b"".join(d for _, d in samples)
    wave = [b - 128 for b in payload]
    mean, rms = (sum(wave) / len(wave), (sum(x * x for x in wave) / len(wave)) ** 0.5) if wave else (0.0, 0.0)
    turns = sum((a < 0) != (b < 0) for a, b in zip(wave, wave[1:]))
    times = sha(",".join(str(s * 1_000_000 // rate) for s, _ in samples))[:16]
    return payload, f"streams={len(packets)};pages={pages};packets={len(samples)};micros={len(payload) * 1_000_000 // rate};times={times};mean={mean:.4f};rms={rms:.4f};crossings={turns}"


def test_ogg(spark, rows, folder):
    want, texts = Counter(), {r[1] or "" for r in rows}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    media = {r.text: bytes(r.m) for r in df.select("text", ogg.to_ogg(ogg.padded(F.col("text"))).alias("m")).collect()}
    for r in rows:
        data = (r[1] or "").encode()
        whole, kept = data.ljust(max(1, -(-len(data) // 192)) * 192), media[r[1] or ""]
        payload, feature = plain_ogg(kept)
        assert payload == whole
        want[(r[0], len(data), len(whole), sha(whole), zlib.crc32(whole[-16:]), len(kept), sha(kept), feature)] += 1
    assert Counter(map(tuple, ogg.op3_ogg(spark, folder).collect())) == want


def test_media_is_written_once_and_read_back_from_those_bytes(spark):
    df = spark.createDataFrame([(b"a" * 3000,), (b"",), (None,)], "p binary")
    for r in df.select("p", ogg.stored_ogg(F.col("p")).alias("s")).collect():
        assert r.s.payload == r.p and (r.p is None or ogg.features(bytes(r.s.media)) == (bytes(r.s.payload), r.s.feature))
    assert df.select(ogg.from_ogg(ogg.to_ogg(F.col("p"))).alias("b")).where("b.payload = X''").count() == 1


# 4


def test_line_dedup(spark, folder, rows):
    docs = spark.createDataFrame([(i, "h", f" hot \nown {i}\n\nhot\nrare" if i < 8 else f"own {i}\r\nhot {i}", "keep") for i in range(20)] + [(90, None, "hot", "k"), (91, "h", None, "k"), (92, "h", "", "k")], "doc_id long, source string, text string, _lines string").withColumn("_dropped", F.lit("mine"))
    out = {r.doc_id: r for r in line_dedup.drop_boilerplate(docs, ratio=0.3, counts="n").collect()}
    assert out[0].text == "own 0\n" and tuple(out[0]["n"]) == (5, 3) and (out[0]["_lines"], out[0]["_dropped"]) == ("keep", "mine")
    # The only page of the null host has nothing but boilerplate.
    assert out[9].text == "own 9\r\nhot 9" and out[90].text == "" and out[91].text is None and out[92].text == ""
    assert (out[91]["n"].lines, out[92]["n"].lines) == (0, 1)
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(docs, ratio=0.3, min_pages=2).collect()}[90] == "hot"
    got = Counter((r.doc_id, r.source, r.n_lines, r.n_dropped, r.text) for r in line_dedup.op4_line_dedup(spark, folder).collect())
    assert got == brute_lines(rows)


def brute_lines(rows, least=1):
    pages, host = defaultdict(Counter), Counter()
    for r in rows:
        host[r[3]] += 1
        for x in {x.strip(BLANKS) for x in (r[1] or "").split("\n")} - {""}:
            pages[r[3]][x] += 1
    out = Counter()
    for r in rows:
        lines = [] if r[1] is None else r[1].split("\n")
        kept = [x for x in lines if not (pages[r[3]][x.strip(BLANKS)] >= least and pages[r[3]][x.strip(BLANKS)] > 0.1 * host[r[3]])]
        out[(r[0], r[3], len(lines), len(lines) - len(kept), r[1] if r[1] is None else "\n".join(kept))] += 1
    return out


def test_hosts(spark):
    urls = {"http://E.example/a": "e.example", "https://u:p@h.example:80/x@y": "h.example", "ftp://h": "h", "//h/a": None, "h.example/a": None, "http://[::1]:8/": "[::1]", None: None, "": None, "http:///a": None, "http://h?q#f": "h"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.h for r in df.select("u", line_dedup.host_of(F.col("u")).alias("h")).collect()} == urls


def test_line_dedup_of_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    host = lambda u: re.match(r"http://([^/]+)", u)[1] if u and u.startswith("http://") else None
    want = brute_lines([(p.page_id, p.html, None, host(p.url)) for p in pages], 2)
    assert Counter(map(tuple, line_dedup.line_dedup_pages(spark, folder).collect())) == want


def test_line_dedup_without_broadcast(spark, folder, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    got = Counter((r.doc_id, r.source, r.n_lines, r.n_dropped, r.text) for r in line_dedup.op4_line_dedup(spark, folder).collect())
    assert got == brute_lines(rows)


# 5


def check_bpe(spark, texts, **sizes):
    encoder = bpe.codec(bpe.default_ranks(), bpe.default_pattern())[0]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").withColumn("key", F.lit("x")).withColumn("bpe", F.lit("y"))
    for r in bpe.encode_texts(df, **sizes).collect():
        text = texts[r.i] or ""
        ids = encoder.encode_ordinary(text)
        assert (r.bpe.n_tokens, r.bpe.ids, bytes(r.bpe.decoded).decode()) == (len(ids), ",".join(map(str, ids)), text)
        assert r.key == "x"


def test_bpe_chunks(spark):
    texts = [None, "", "a", "I'll go, don't we're " * 40, "x" * 500, "   \n\n  a  b " * 50, "漢字 é <|endoftext|> " * 40, "1234 5678" * 60, "'" * 300, "a\r\n b  c 'll" * 30, "same " * 100, "same " * 100]
    check_bpe(spark, texts)
    check_bpe(spark, texts, chunk=64, overlap=16)
    check_bpe(spark, texts, chunk=37, overlap=9)


@pytest.mark.parametrize("gap", ["\n\n", "\t\t", "\n\n\n\n", " \n", "\u00a0\u00a0"])
def test_bpe_pieces_do_not_end_in_white_space(spark, tmp_path, gap):
    pieces = [bytes([b]) for b in range(256)] + [gap.encode()[:k] for k in range(2, len(gap.encode()) + 1)]
    ranks = tmp_path / "ranks.tiktoken"
    ranks.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(dict.fromkeys(pieces))))
    encoder = bpe.codec(str(ranks), bpe.default_pattern())[0]
    # White space ends at, before and after the end of a chunk, and words follow to cut at or don't.
    texts = ["a" * k + gap + tail for k in range(20) for tail in ("word and more words here", "w" * 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    for overlap in (6, 12):
        for r in bpe.encode_texts(df, path=str(ranks), chunk=16, overlap=overlap).collect():
            assert (r.bpe.ids, bytes(r.bpe.decoded).decode()) == (",".join(map(str, encoder.encode_ordinary(texts[r.i]))), texts[r.i])


def joins(plan):
    """The schemas of the two sides of each join in a plan."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    own = [[c.schema().simpleString() for c in children]] if plan.nodeName() == "Join" else []
    return own + [j for c in children for j in joins(c)]


def test_bpe_digests_meet_no_texts(spark):
    """Neither long texts nor their ids and bytes pass through the join, only what the query derives from them."""
    encoder = bpe.codec(bpe.default_ranks(), bpe.default_pattern())[0]
    texts = ["", "short", "x" * 70_000, "several words and more " * 3_000, "several words and more " * 3_000, "é漢 \n" * 20_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.token_digests(docs)
    sides = joins(out._jdf.queryExecution().optimizedPlan())
    assert sides and not [s for pair in sides for s in pair if "text" in s or "ids:" in s or "decoded:" in s]
    want = Counter((i, len(ids := encoder.encode_ordinary(t or "")), sha(",".join(map(str, ids))), sha(t or "")) for i, t in enumerate(texts))
    assert Counter(map(tuple, out.collect())) == want


def test_bpe_query(spark, folder, rows):
    encoder = bpe.codec(bpe.default_ranks(), bpe.default_pattern())[0]
    want = Counter()
    for r in rows:
        ids = encoder.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), sha(",".join(map(str, ids))), sha(r[1] or ""))] += 1
    assert Counter(map(tuple, bpe.op5_bpe(spark, folder).collect())) == want


# 6


def test_token_counts_follow_the_tie_rule():
    counter = unigram.CountViterbi({"▁": -3.0, "a": -1.0, "aa": -2.0, "b": -1.0, "aab": -9.0, "▁a": -4.0, "▁▁": -6.0}, True)

    def slow(text):
        text = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [None] * len(text)
        for start in range(len(text)):
            for end in range(start + 1, len(text) + 1):
                score = {"▁": -3.0, "a": -1.0, "aa": -2.0, "b": -1.0, "aab": -9.0, "▁a": -4.0, "▁▁": -6.0}.get(text[start:end])
                n = 1
                if score is None and end == start + 1:
                    score, n = -19.0, len(text[start].encode())
                if score is not None and (best[end] is None or best[start][0] + score > best[end][0]):
                    best[end] = (best[start][0] + score, best[start][1] + n)
        return best[-1][1]

    rng = np.random.default_rng(4)
    for _ in range(400):
        text = "".join(rng.choice(list("aab é "), int(rng.integers(1, 14))))
        assert counter.count(text) == slow(text)
    assert counter.count(None) == counter.count("") == 0


def test_token_counts_equal_a_library(spark, folder, rows):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram

    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=unigram.default_model())
    other = Tokenizer(Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], unk_id=0, byte_fallback=True))
    count = lambda t: len(other.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0
    got = Counter(map(tuple, unigram.op6_token_counts(spark, folder).collect()))
    assert got == Counter((r[0], count(r[1] or ""), len(r[1] or "")) for r in rows)


def test_a_full_cache_gives_the_same_counts(monkeypatch):
    monkeypatch.setattr(unigram, "CACHED", 2)
    counter = unigram.CountViterbi({"▁": -3.0, "a": -1.0}, False)
    text = "a aa aaa a b"
    fresh = unigram.CountViterbi({"▁": -3.0, "a": -1.0}, False)
    monkeypatch.setattr(unigram, "CACHED", 1 << 19)
    want = fresh.count(text)
    monkeypatch.setattr(unigram, "CACHED", 2)
    # Five marks, seven letters a, and one character that is no piece.
    assert want == 5 + 7 + 1
    for _ in range(3):
        assert counter.count(text) == want and len(counter) <= 2


# 7


def slow_simhash(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("at_once", [1, 7, 64, 1 << 18])
def test_fingerprints_of_long_texts_come_in_pieces(at_once):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abÉ"), int(rng.integers(1, 9)))) for _ in range(50)]
    for text in ["", " ", "A", "a b", "a b c", "x" * 500, " \n".join(rng.choice(words, 300)), "  lead " + "y" * 90 + " tail\t"]:
        assert simhash.simhash64(text.encode(), at_once=at_once) == slow_simhash(text)
        assert b"".join(simhash.pieces_of(text.encode(), at_once)) == text.encode()


def test_a_long_text_takes_bounded_memory():
    data = b"word " * 800_000
    tracemalloc.start()
    simhash.simhash64(data)
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.reset_peak()
    f = langid.Filters(["a", "b"], [np.array([1, 2], dtype=np.uint64)] * 2, 1 << 10)
    f.predict(data.decode())
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()


def brute_components(prints, ids, alike=lambda i, j: False):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 or alike(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(spark, folder, rows):
    prints = [slow_simhash(r[1]) for r in rows]
    roots = brute_components(prints, [r[0] for r in rows])
    want = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, roots, strict=True))
    assert Counter(map(tuple, simhash.op7_simhash(spark, folder).collect())) == want


def test_balls_lose_no_link(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 40)]
    prints = list(base)
    for b in base[:20]:
        for _ in range(6):
            b ^= (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            prints.append(b - (1 << 64) if b >= 1 << 63 else b)
    df = spark.createDataFrame([(i, ((p + (1 << 63)) % (1 << 64)) - (1 << 63)) for i, p in enumerate(prints)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.with_components(df).collect()}
    assert [got[i] for i in range(len(prints))] == brute_components([p & (1 << 64) - 1 for p in prints], list(range(len(prints))))


def test_components(spark):
    links = [(a, a + 1) for a in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(texts, ids):
    """brute_components() with all pairs compared by the second key too."""
    keys = [simhash.minhash((t or "").encode()) for t in texts]

    def alike(i, j):
        (a, a_bands), (b, b_bands) = keys[i], keys[j]
        same = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
        return bool(set(a_bands.tolist()) & set(b_bands.tolist())) and (same - 1 / 256) / (1 - 1 / 256) >= fingerprints.NEAR

    return brute_components([slow_simhash(t) for t in texts], ids, alike)


def test_second_key(spark):
    """Near copies of resemblance 0.8 and more are found, and unlike texts, short ones too, stay."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [[word() for _ in range(int(rng.integers(60, 400)))] for _ in range(60)]
    texts, near = [" ".join(w) for w in base], {}
    for k, w in enumerate(base):
        other = list(w)
        # An edit of a word changes five shingles.
        for at in rng.choice(len(w), max(1, len(w) // 60), replace=False):
            other[at] = word()
        a, b = shingles(" ".join(w)), shingles(" ".join(other))
        if len(a & b) / len(a | b) >= 0.8:
            near[len(texts)] = k
            texts.append(" ".join(other))
    texts += [f"{word()} {word()}" for _ in range(300)] + [word() for _ in range(300)]
    assert len(near) > 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stay = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert sum(k not in stay for k in near) >= 0.95 * len(near)
    assert set(range(len(texts))) - set(near) <= stay
    for k, of in near.items():
        (a, _), (b, _) = (simhash.minhash(texts[i].encode(), at_once=97) for i in (k, of))
        true = len(shingles(texts[k]) & shingles(texts[of])) / len(shingles(texts[k]) | shingles(texts[of]))
        assert abs(sum(x == y for x, y in zip(a, b, strict=True)) / 256 - true) < 0.12


@pytest.mark.parametrize("at_once", [1, 64, 1 << 18])
def test_second_key_in_pieces(at_once):
    for text in ["", "a", "a b c d", "a b c d e", "x y " * 200, "  lead " + "y" * 90 + " tail\t"]:
        one, other = simhash.minhash(text.encode()), simhash.minhash(text.encode(), at_once=at_once)
        assert one[0] == other[0] and one[1].tolist() == other[1].tolist()
        assert len(one[0]) == 256 and len(one[1]) == (32 if text.split() else 0)


def test_one_document_of_each_group_stays(spark, folder, rows):
    out = simhash.drop_near_copies(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    roots = brute_groups([r[1] for r in rows], [r[0] for r in rows])
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted({c for c in roots if c is not None})
    assert all(r.fp == r.row == "x" for r in out)


# 8


def brute_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    groups = defaultdict(list)
    for p in pages:
        groups[p.html or ""].append(p)
    out = Counter()
    for html, same in groups.items():
        data, best = html.encode(), max((p.page_id for p in same if p.page_id is not None), default=None)
        first = True
        for p in same:
            response = len(data) < 1000 or (p.page_id == best and first)
            first = first and not (p.page_id == best and len(data) >= 1000)
            out[(p.page_id, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response else best)] += 1
    return out


def test_warc(spark, folder):
    assert Counter(map(tuple, warc.op8_warc(spark, folder).collect())) == brute_pages(spark, folder)


def test_records_are_whole(spark, folder):
    path = warc.new_archive(spark)
    warc.write_archive(spark.read.parquet(f"{folder}/pages.parquet"), path)
    pages = Counter((r.page_id, r.html or "") for r in spark.read.parquet(f"{folder}/pages.parquet").collect())
    records = warc.read_archive(spark, path).collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in records) == pages
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert len(rest) == int(fields[b"Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        http, _, body = rest[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {r.payload_bytes}".encode() in http.split(b"\r\n")
        assert body == (b"" if r.record_type == "revisit" else bytes(r.payload))
    ids = [re.search(rb"WARC-Record-ID: (.*?)\r\n", bytes(r.header))[1] for r in records]
    assert len(set(ids)) == len(ids)
    said = {re.search(rb"WARC-Refers-To: (.*?)\r\n", bytes(r.header))[1] for r in records if r.record_type == "revisit"}
    assert said <= {i for i, r in zip(ids, records, strict=True) if r.record_type == "response"}
    assert spark.read.parquet(f"{path}/blobs").count() == len({h for _, h in pages})


def test_warc_files(spark, folder, tmp_path):
    path = warc.new_archive(spark)
    warc.write_archive(spark.read.parquet(f"{folder}/pages.parquet"), path)
    warc.write_files(spark, path, str(tmp_path / "w"), 7)
    got = Counter((r.page_id, r.record_type, r.refers_to, r.payload_digest) for r in warc.read_files(spark, str(tmp_path / "w")).collect())
    assert got == Counter({(p, k, to, d): n for (p, _, d, k, to), n in brute_pages(spark, folder).items()})
    assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in warc.read_files(spark, str(tmp_path / "w")).where("record_type = 'response'").collect())
    for bad in (b"junk\r\n\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(bad))


URLS = ["http://e/\u2028WARC-Payload-Digest: sha1:0", "http://e/\u2028WARC-Refers-To: <urn:page:9/x>", "http://e/\u0085b", "http://e/\u2029WARC-Type: revisit", "a\nWARC-Type: revisit", "a\r\n\r\nHTTP/1.1 500", "\r", " http://e/ ", "WARC-Type: revisit", "http://e/%0A", "é" * 80 + "\n", "x: y: z", "\\r\\n$1", None, ""]


def test_urls_are_kept_byte_by_byte(spark, tmp_path):
    rows = [(i, u, "<p>" + "z" * (1200 if i % 2 else 3)) for i, u in enumerate(URLS)]
    path = warc.new_archive(spark)
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_archive(spark, path).collect()
    best = max(i for i, _, html in rows if len(html) >= 1000)
    assert sorted((r.page_id, r.url, r.record_type, r.refers_to) for r in got) == sorted((i, u or None, *(("response", None) if len(h) < 1000 or i == best else ("revisit", best))) for i, u, h in rows)
    assert all(bytes(r.payload).decode() == rows[r.page_id][2] for r in got)
    warc.write_files(spark, path, str(tmp_path / "w"))
    assert {r.page_id: r.url for r in warc.read_files(spark, str(tmp_path / "w")).collect()} == {i: u or None for i, u, _ in rows}


def test_damage_is_found(spark, folder):
    path = warc.new_archive(spark)
    warc.write_archive(spark.read.parquet(f"{folder}/pages.parquet"), path)
    spark.read.parquet(f"{path}/blobs").limit(3).write.parquet(f"{path}-less/blobs")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-less/headers")
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archive(spark, f"{path}-less").collect()


# 9


def check_shards(got, total, shards):
    sizes = Counter(r.shard for r in got)
    assert sum(sizes.values()) == total and max(sizes.values()) - (min(sizes.values()) if len(sizes) == shards else 0) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding(spark, folder, rows):
    got = sharding.op9_sharding(spark, folder).collect()
    data = [(r[1] or "").encode() for r in rows]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], 16 + len(d), zlib.crc32(d)) for r, d in zip(rows, data, strict=True))
    check_shards(got, len(rows), 40)
    assert Counter(map(tuple, got)) == Counter(map(tuple, sharding.op9_sharding(spark, folder).collect()))


def test_many_parts_and_pieces_are_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 64)
    monkeypatch.setattr(sharding, "PIECE_ROWS", 32)
    df = spark.range(4003).withColumn("shard", F.lit("x")).withColumn("other", F.lit(1))
    got = sharding.uniform_shards(df, ["id"], 7).collect()
    check_shards(got, 4003, 7)
    # Neighbours meet in a shard as often as chance has it, and slots don't follow ids.
    by = {r.id: (r.shard, r.slot) for r in got}
    same = sum(by[i][0] == by[i + 1][0] for i in range(4002)) / 4002
    assert abs(same - 1 / 7) < 0.03
    assert abs(np.corrcoef([i for i in by], [s for _, s in by.values()])[0, 1]) < 0.06


def test_matrix_has_exact_margins():
    counts, sizes = [5, 0, 17, 100], [31, 31, 30, 30]
    m = sharding.communication_matrix(counts, sizes, 1)
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes and m.min() >= 0
    mean = np.mean([sharding.communication_matrix(counts, sizes, s) for s in range(300)], axis=0)
    assert np.abs(mean - np.outer(counts, sizes) / 122).max() < 0.7
    assert sharding.communication_matrix([1 << 40, 1 << 40], [1 << 40, 1 << 40], 3).sum() == 1 << 41


def test_large_draws_follow_the_exact_law():
    # Three rows of a partition, one of 101 of which goes to the small shard; a rounded normal hardly ever sends one there.
    sizes = [10**9, 10**11]
    sent = Counter(int(sharding.communication_matrix([3, sum(sizes) - 3], sizes, s)[0, 0]) for s in range(3000))
    assert abs(3000 - sent[0] - 3000 * (1 - (100 / 101) ** 3)) < 45


@pytest.mark.parametrize("good,bad,drawn", [(7, 9, 6), (300, 500, 40), (5, 400, 390), (1, 3, 2)])
def test_any_draw_follows_the_exact_law(good, bad, drawn):
    rng, n = np.random.default_rng(5), 4000
    got = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    law = {k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) for k in range(max(0, drawn - bad), min(good, drawn) + 1)}
    assert set(got) <= set(law)
    assert all(abs(got[k] - n * p) <= 5 * (n * p * (1 - p)) ** 0.5 + 1 for k, p in law.items())


def test_large_draws_spread_as_they_should():
    rng, good, bad, drawn = np.random.default_rng(6), 10**12, 3 * 10**12, 10**11
    x = np.array([sharding.hypergeometric(rng, good, bad, drawn) - drawn // 4 for _ in range(2000)], dtype=float)
    sd = (drawn * 0.25 * 0.75 * (good + bad - drawn) / (good + bad - 1)) ** 0.5
    assert abs(x.mean()) < 5 * sd / 2000**0.5 and abs(x.std() / sd - 1) < 0.08
    assert abs((np.abs(x) < sd).mean() - 0.6827) < 0.05


# 10


def test_language_id(spark, folder, rows):
    got = langid.op10_language_id(spark, folder).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r.held_out for r in got if r.doc_id is not None}
    assert held == {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows if r[0] is not None}
    nothing = {2000, 2001, 2002, 2005}
    assert {r.doc_id for r in got if r.lang_pred == "und"} - {None} == nothing
    assert all(r.lang_pred in ("en", "fr", "und") for r in got)


def plain_grams(text):
    """N-grams of five bytes of the letters' runs, by a scan of the characters."""
    out = " "
    for c in text.lower():
        out += c if unicodedata.category(c)[0] == "L" else ("" if out[-1] == " " else " ")
    data = out.encode() if out[-1] == " " else (out + " ").encode()
    return [data[i : i + 5] for i in range(max(1, len(data) - 4))]


def test_predictions_equal_those_by_sets(spark, folder, rows):
    """Sets of n-grams in place of filters, over the same texts: all labelled ones, as they are few."""
    known, texts = defaultdict(set), Counter()
    for r in rows:
        if r[0] is not None and r[1] is not None and r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2:
            known[r[2]].update(plain_grams(r[1]))
            texts[r[2]] += 1
    order = sorted(known, key=lambda x: (-texts[x], x))
    got = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.op10_language_id(spark, folder).collect()}
    want = set()
    for r in rows:
        if not r[1] or not any(unicodedata.category(c)[0] == "L" for c in r[1]):
            want.add((r[0], "und", 0.0))
            continue
        grams = plain_grams(r[1])
        share = [sum(g in known[x] for g in grams) / len(grams) for x in order]
        want.add((r[0], order[share.index(max(share))], round(max(share), 9)))
    close = {(d, x): s for d, x, s in want}
    assert {(d, x) for d, x, _ in got} == set(close)
    # What filters let through falsely is all that scores differ by.
    assert all(abs(s - close[d, x]) < 1e-3 for d, x, s in got if d is not None)


@pytest.mark.parametrize("size", [1, 5, 64, 1 << 16])
def test_pieces_have_the_grams_of_the_whole_text(size):
    for text in ["abc", "", "12", "Hello, wörld -- again  x", "a" * 300, "12ab!?cd" * 30, " é\n\nÉ" * 40, "x1" * 50]:
        got = [int(g).to_bytes(5, "big").rstrip(b"\0") for part in langid.gram_pieces(text, size) for g in part]
        assert got == plain_grams(text)


def test_the_sample_is_bounded(spark):
    texts = [(i, f"{'ab' if i % 2 else 'cd'}{i:03d} " * 10 if i else "z" * 5000, "x", "s", 1) for i in range(60)]
    whole = langid.train(spark.createDataFrame(texts, DOCS), "doc_id", "text", "lang")
    part = langid.train(spark.createDataFrame(texts, DOCS), "doc_id", "text", "lang", sample_chars=400)
    long = np.array([int.from_bytes(b"zzzzz", "big")], dtype=np.uint64)
    assert whole.counts(long)[0] == 1 and part.counts(long)[0] == 0
    assert np.count_nonzero(part.table) < np.count_nonzero(whole.table)


@pytest.mark.skipif(not oracle.HAVE, reason="no test tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op10_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_filters_return_all_languages_of_a_gram():
    rng = np.random.default_rng(6)
    grams = [rng.integers(0, 1 << 40, 3000).astype(np.uint64) for _ in range(10)]
    f = langid.Filters([f"l{k}" for k in range(10)], grams, 1 << 16)
    for k, g in enumerate(grams):
        counts = f.counts(g)
        assert counts[k] == len(g)
        others = np.delete(counts, k) / len(g)
        assert np.abs(others - np.delete(f.falsely, k)).max() < 0.01
    with pytest.raises(ValueError):
        langid.Filters([str(k) for k in range(65)], [grams[0]] * 65)


def test_only_unknown_texts_are_rejected(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in langid.known_language(docs).collect()}
    assert not kept & {2000, 2001, 2002, 2005} and {0, 3, 1000, 2003, 2004} <= kept


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None, "a", 10)], DOCS)
    assert langid.train_on_documents(docs).predict("some words") == ("und", 0.0)


def test_words(spark):
    texts = ["", None, " a\tb\x0bc  ", " x y z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", common.text_words(F.col("t")).alias("w"), common.word_count(F.col("t")).alias("n")).collect()
    for r in rows:
        want = [x.decode() for x in words_of(r.t)]
        assert r.w == want and r.n == len(want)
