"""Near-duplicate groups by SimHash and meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits, each set if over half of its shingle hashes
have it. Two fingerprints within ``radius`` bits share a variant that lies within
half the radius of both. So every distinct fingerprint emits all its variants,
the variants are shuffled, and each variant links its fingerprints to their
smallest one. A variant has no more fingerprints than its own ball (65 for half
a radius of 1), however large a group of near copies is. Links are deduplicated,
verified, and joined into components.

Copies meet before that: all rows of one fingerprint are one node, found with
partial minima, so that a group of copies of any size costs one row a task.

Defined results:

* null and empty texts, and texts without words, have the fingerprint 0, which
  links like any other; fewer words than a shingle make one shingle;
* a component's id is the smallest doc_id in it; null ids come last, and a
  component of only null ids has a null id;
* repeated rows are members like others; an empty table gives no rows; other
  columns are kept, but for those that the functions below say they add;
* a very long text is hashed in pieces of ``AT_ONCE`` bytes.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, table, unwrapped, wrapped
from .components import components
from .fingerprints import BANDS, BINS, band_links

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Bytes of a text whose shingles are hashed at once; a longer word makes a piece as long as itself.
AT_ONCE = 1 << 18
#: Variants of fingerprints in one task.
VARIANTS_TOGETHER = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces_of(data: bytes, size: int):
    """The parts of a text, cut at white space, of about ``size`` bytes each."""
    at = 0
    while at < len(data):
        met = _BLANK.search(data, at + size)
        end = met.start() if met else len(data)
        yield data[at:end]
        at = end


def word_pieces(data: bytes, shingle: int, at_once: int | None = None):
    """The lower-cased words of a text, piece by piece; each piece begins with the words that the last one's shingles hadn't begun with."""
    before = []
    for piece in pieces_of(data, at_once or AT_ONCE):
        # For bytes, lower() changes A to Z only, and split() cuts at the bytes 9 to 13 and 32.
        words = before + piece.lower().split()
        yield words
        before = words[max(0, len(words) - shingle + 1) :]


def simhash64(data: bytes, shingle: int = SHINGLE, at_once: int | None = None) -> int:
    """The fingerprint of a text's UTF-8 bytes, unsigned."""
    digest, counts, total, words = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0, []
    for words in word_pieces(data, shingle, at_once):
        n = len(words) - shingle + 1
        if n > 0:
            grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
            counts += _bits(np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=n))
            total += n
    if not total:
        # Fewer words than a shingle: all that there are.
        if not words:
            return 0
        counts, total = _bits(np.array([digest(b" ".join(words), SEED)], dtype="<u8")), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


#: Words in the shingles of the second key, and probes that an empty bin makes.
WIDE, TRIES = 5, 64
_PROBES = np.random.default_rng(SEED).integers(0, BINS, (BINS, TRIES))


def minhash(data: bytes, shingle: int = WIDE, at_once: int | None = None) -> tuple[bytes, np.ndarray]:
    """The one-permutation MinHash of a text's shingles: the low byte of each bin, and a key for each band of whole bins.

    Keys are made of all bits, so that texts of few shingles, whose bins are all
    alike, don't meet by chance. A text without words has zeros and no keys.
    """
    digest, none = xxhash.xxh64_intdigest, np.uint64(0xFFFFFFFFFFFFFFFF)
    least, found, words = np.full(BINS, none), False, []

    def take(words: list[bytes], size: int) -> None:
        of = np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
        h = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k in range(size):
            h = (h ^ of[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        np.minimum.at(least, (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), h)

    for words in word_pieces(data, shingle, at_once):
        if len(words) >= shingle:
            take(words, shingle)
            found = True
    if not found:
        if not words:
            return bytes(BINS), np.zeros(0, dtype=np.uint64)
        take(words, len(words))
    full = least != none
    filled, done = least.copy(), full.copy()
    for k in range(TRIES):
        if done.all():
            break
        at = _PROBES[:, k]
        now = ~done & full[at]
        filled[now] = least[at[now]]
        done |= now
    if not done.all():
        # No probe has met a value: the next bin that has one.
        where = np.flatnonzero(full)
        rest = np.flatnonzero(~done)
        filled[rest] = least[where[np.searchsorted(where, rest) % len(where)]]
    rows, keys = filled.reshape(BANDS, -1), np.arange(BANDS, dtype=np.uint64)
    for k in range(rows.shape[1]):
        keys = (keys ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return (filled & np.uint64(255)).astype(np.uint8).tobytes(), keys


@F.arrow_udf(T.LongType())
def _simhash(data: pa.Array) -> pa.Array:
    found = np.fromiter((simhash64(x.as_py() or b"") for x in data), dtype="<u8", count=len(data))
    return pa.array(found.view("<i8"), type=pa.int64())


_BOTH = T.StructType([T.StructField("fp", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.arrow_udf(_BOTH)
def _both(data: pa.Array) -> pa.Array:
    prints, packed, bands = [], [], []
    for x in data:
        text = x.as_py() or b""
        prints.append(simhash64(text))
        least, keys = minhash(text)
        packed.append(least)
        bands.append(keys.view(np.int64))
    fp = np.array(prints, dtype="<u8").view("<i8")
    return pa.StructArray.from_arrays([pa.array(fp, type=pa.int64()), pa.array(packed, type=pa.binary()), pa.array(bands, type=pa.list_(pa.int64()))], names=_BOTH.names)


def both_prints(text: Column) -> Column:
    """struct(fp, print, bands): the SimHash as a signed long, and the packed MinHash with the keys of its bands."""
    small_batches(SparkSession.active())
    return _both(text.cast("binary"))


def simhash(text: Column) -> Column:
    """The fingerprint as a signed long."""
    small_batches(SparkSession.active())
    return _simhash(text.cast("binary"))


def ball_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links that join all distinct fingerprints (column ``fp``, kept as a table) within ``radius`` bits of each other.

    ``radius`` is even, so that all fingerprints of one variant are within the
    radius of each other, and a star around the smallest loses no link.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    # Each fingerprint becomes many rows: it is few bytes before that, so the number of tasks is said here.
    parts = max(1, prints.count() * len(masks) // VARIANTS_TOGETHER)
    variants = prints.repartition(parts, "fp").select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in signed])).alias("variant"))
    # A variant has no more rows than its ball, so a window over it is small.
    met = variants.withColumn("m", F.min("fp").over(Window.partitionBy("variant")))
    links = met.where("fp != m").select("fp", "m").distinct()
    return links.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("m"))) <= radius)


def with_components(rows: DataFrame, value: str = "doc_id", radius: int = RADIUS, more: DataFrame | None = None) -> DataFrame:
    """``rows`` (with ``fp``) and ``component_id``, the smallest ``value`` among the rows of linked fingerprints.

    ``more`` are links between fingerprints besides those within the radius.
    """
    links = ball_links(cut(rows.select("fp").distinct()), radius)
    groups = components(links if more is None else links.union(more))
    first = rows.groupBy("fp").agg(F.min(value).alias("_first"))
    linked = first.join(groups, F.col("fp") == F.col("node")).select("fp", "_first", "root")
    # The roots are fingerprints themselves, and not among the linked nodes.
    own = first.join(groups.select(F.col("root").alias("fp")).distinct(), "fp", "left_semi").select("fp", "_first", F.col("fp").alias("root"))
    members = cut(linked.unionByName(own))
    least = cut(members.groupBy("root").agg(F.min("_first").alias("_least")))
    moved = members.join(least, "root").select(F.col("fp").alias("_fp"), F.col("_least").alias("component_id"))
    others = first.join(members.select("fp"), "fp", "left_anti").select(F.col("fp").alias("_fp"), F.col("_first").alias("component_id"))
    # Kept as a table, so that the join below has nothing but two exchanges under it and its hot fingerprints can be split.
    ids = cut(moved.unionByName(others))
    return rows.join(ids, F.col("fp") == F.col("_fp"), "left").drop("_fp")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id.

    Fingerprints within ``radius`` bits find copies and very light edits. Texts
    whose sets of five-word shingles have a resemblance of 0.8 are some 7 bits apart, too
    many for balls; they are found by a second key, bands of one-permutation
    MinHash fingerprints, and linked if these are alike. Of texts with
    one SimHash one stands for all there. Of rows that are equal in id and text
    one stays.
    """
    code = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    # Null ids come last.
    rank = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), code.alias("code"))
    rows = cut(docs.select(rank.alias("rank"), both_prints(F.col(text)).alias("both")).select("rank", "both.*"))
    prints = cut(rows.groupBy(F.col("fp").alias("node")).agg(F.min(F.struct("print", "bands")).alias("least")).select("node", "least.*"))
    kept = with_components(rows.select("rank", "fp"), "rank", radius, band_links(prints)).where(F.col("rank") == F.col("component_id")).groupBy("rank").agg(F.count(F.lit(1)).alias("_rows"))
    kept = cut(kept.select(F.col("rank.id").alias("_id"), F.col("rank.code").alias("_code"), "_rows"))
    whole = wrapped(docs)
    own = F.xxhash64(F.coalesce(F.col("_doc")[text], F.lit("")))
    met = whole.join(kept, F.col("_doc")[doc_id].eqNullSafe(F.col("_id")) & (own == F.col("_code")))
    once = met.where("_rows = 1").select("_doc")
    if not kept.where("_rows > 1").isEmpty():
        once = once.unionByName(met.where("_rows > 1").dropDuplicates(["_id", "_code"]).select("_doc"))
    return unwrapped(once, docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the id of its near-duplicate component."""
    docs = table(spark, sf_dir, "documents")
    rows = cut(docs.select("doc_id", simhash(F.col("text")).alias("fp")))
    out = with_components(rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
