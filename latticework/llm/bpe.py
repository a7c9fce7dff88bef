"""Byte-level BPE by overlapping chunks.

Texts of up to ``CHUNK`` characters are encoded where they lie. Longer ones are
cut into chunks that overlap; each chunk is split into pre-tokens from its own
start, in parallel. Splitting is a scan without memory: once two scans share a
boundary they share all later ones. So chunk k + 1 takes over from chunk k at
the first boundary in their overlap that both have and that doesn't follow white
space, and the pieces between these places are encoded in parallel. A text in which some overlap has no common
boundary is put together from its chunks again and encoded in one go. Decoding
concatenates the tokens' bytes.

A long text is handled once for all rows that have it, by its digest; the ids of
its pieces are put together again in one row, as long as the text itself. What a
caller derives from that row is derived there, so that no more than that, and the
columns that are asked for, meets the text's rows.

Defined results: null counts as an empty text, which has no tokens; special
tokens' strings are ordinary text; equal texts have equal results; repeated rows
and other columns are kept; an empty table gives no rows. The result is one struct
column whose name the caller gives; a column of that name is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, unwrapped, wrapped

#: Characters in a chunk, and those that it has in common with the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 10
#: Chunks that a text's cutting gives out at once.
CHUNKS_TOGETHER = 16
#: A pre-token is settled if the text goes on for so many characters after it.
AHEAD = 3
RANKS = "byte_bpe_multi_50k.tiktoken"

RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.BinaryType())])
MARKS = T.StructType([T.StructField("heads", T.ArrayType(T.LongType())), T.StructField("tails", T.ArrayType(T.LongType()))])


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    """The encoder of a rank file, the decimal form of each id, and its bytes."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    size = max(ranks.values()) + 1
    pieces = [b""] * size
    for data, rank in ranks.items():
        pieces[rank] = data
    return encoder, [str(i) for i in range(size)], pieces


def encode(text: str, path: str, pattern: str) -> tuple[int, str, bytes]:
    """Number of tokens, their ids joined by commas, and the bytes that these decode to."""
    encoder, names, pieces = codec(path, pattern)
    ids = encoder.encode_ordinary(text)
    return len(ids), ",".join(map(names.__getitem__, ids)), b"".join(map(pieces.__getitem__, ids))


def boundaries(chunk: str, pattern: str, last: bool) -> list[int]:
    """Where pre-tokens begin or end in a chunk; those that the text after it might move are left out."""
    found = [0]
    for m in regex.compile(pattern).finditer(chunk):
        found.append(m.end())
    return found if last else [p for p in found if p <= len(chunk) - AHEAD]


def encode_columns(text: Column, path: str, pattern: str) -> Column:
    """struct(n_tokens, ids, decoded) of a text column, each text in one go."""
    small_batches(SparkSession.active())

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        found = [encode(t or "", path, pattern) for t in texts.to_pylist()]
        columns = [pa.array([f[k] for f in found], type=kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.binary()))]
        return pa.StructArray.from_arrays(columns, names=RESULT.names)

    return run(text)


def pieces_of(long: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n, piece, body) of the texts (key, text), cut where their chunks' pre-tokens resynchronise.

    Of a text in which they don't, all pieces are null, and the bodies make up the whole text; else bodies are null.
    """

    @F.arrow_udf(MARKS)
    def mark(chunks: pa.Array, lasts: pa.Array) -> pa.Array:
        heads, tails = [], []
        for text, last in zip(chunks.to_pylist(), lasts.to_pylist(), strict=True):
            found = boundaries(text, pattern, last)
            heads.append([p for p in found if p <= overlap])
            # After white space the encoder would see a run's end where the whole text goes on, and might split the run in another way.
            tails.append([p - chunk for p in found if p >= chunk and not text[p - 1].isspace()])
        kind = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(heads, type=kind), pa.array(tails, type=kind)], names=MARKS.names)

    def chunks(batches):
        """(key, n, of, chunk) of each text, in one pass through it, a few chunks at a time."""
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                text, name = value.as_py(), key.as_py()
                of = -(-len(text) // chunk)
                for first in range(0, of, CHUNKS_TOGETHER):
                    ns = range(first, min(of, first + CHUNKS_TOGETHER))
                    parts = [text[n * chunk : (n + 1) * chunk + overlap] for n in ns]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(ns), pa.string()), pa.array(list(ns), pa.int32()), pa.array([of] * len(ns), pa.int32()), pa.array(parts, pa.string())], names=["key", "n", "of", "chunk"])

    small_batches(long.sparkSession)
    # A long text's chunks go to as many tasks as there are.
    cut = long.select("key", "text").mapInArrow(chunks, "key string, n int, of int, chunk string").repartition("key", "n")
    reaches_end = F.col("n") == F.col("of") - 1
    marked = cut.withColumn("marks", mark(F.col("chunk"), reaches_end))
    order = Window.partitionBy("key").orderBy("n")
    common = F.array_min(F.array_intersect("marks.tails", F.lead("marks.heads").over(order)))
    stops = marked.select("key", "n", "of", "chunk", common.alias("stop"))
    begins = stops.withColumn("begin", F.when(F.col("n") == 0, 0).otherwise(F.lag("stop").over(order)))
    end = F.when(reaches_end, F.char_length("chunk")).otherwise(F.col("stop") + chunk)
    # Where a stop is missing the piece's text is null, and the whole text is for another way.
    piece = F.substring(F.col("chunk"), (F.col("begin") + 1).cast("int"), (end - F.col("begin")).cast("int"))
    cuts = begins.select("key", "n", "chunk", piece.alias("piece"))
    met = F.bool_and(F.col("piece").isNotNull()).over(Window.partitionBy("key"))
    body = F.substring(F.col("chunk"), 1, chunk)
    return cuts.withColumn("met", met).select("key", "n", F.when(F.col("met"), F.col("piece")).alias("piece"), F.when(~F.col("met"), body).alias("body"))


def encode_texts(
    docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, name: str = "bpe", derive: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``docs`` with a column ``name``: a struct of ``n_tokens``, ``ids`` (decimal, joined by commas) and ``decoded`` bytes.

    With ``derive`` the column holds what this makes of the struct.
    """
    path, pattern, derive = path or default_ranks(), pattern or default_pattern(), derive or (lambda bpe: bpe)
    whole, own = wrapped(docs), F.col("_doc")[text]
    size = F.coalesce(F.char_length(own), F.lit(0))
    short = whole.where(size <= chunk).withColumn("bpe", encode_columns(own, path, pattern)).select("_doc", derive(F.col("bpe")).alias("bpe"))
    long = whole.where(size > chunk).withColumn("_key", F.sha2(own, 256))
    once = long.select(F.col("_key").alias("key"), own.alias("text")).dropDuplicates(["key"])
    pieces = pieces_of(once, path, pattern, chunk, overlap)
    done = pieces.withColumn("bpe", encode_columns(F.col("piece"), path, pattern))
    parts = done.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "bpe", "body"))).alias("all"))
    joined = F.struct(
        F.aggregate("all", F.lit(0).cast("long"), lambda n, x: n + x["bpe"]["n_tokens"]).alias("n_tokens"),
        F.array_join(F.filter(F.transform("all", lambda x: x["bpe"]["ids"]), lambda s: F.length(s) > 0), ",").alias("ids"),
        # Pieces are cut between characters, so each is a text of its own.
        F.array_join(F.transform("all", lambda x: x["bpe"]["decoded"].cast("string")), "").cast("binary").alias("decoded"),
    )
    # Where some overlap has no common boundary the whole text is encoded; the others give the encoder nothing to do.
    met = F.col("all")[0]["body"].isNull()
    whole_text = encode_columns(F.when(~met, F.array_join(F.transform("all", lambda x: x["body"]), "")), path, pattern)
    coded = parts.withColumn("whole", whole_text).select("key", F.when(met, derive(joined)).otherwise(derive(F.col("whole"))).alias("bpe"))
    out = short.unionByName(long.join(coded, F.col("_key") == F.col("key")).select("_doc", "bpe"))
    return unwrapped(out, docs.columns, **{name: F.col("bpe")})


def digests(bpe: Column) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256): the number of tokens, and digests of the ids and of the bytes that they decode to."""
    return F.struct(bpe["n_tokens"].alias("n_tokens"), F.sha2(bpe["ids"], 256).alias("ids_sha256"), F.sha2(bpe["decoded"], 256).alias("decoded_sha256"))


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes that they decode to."""
    return encode_texts(docs.select("doc_id", "text"), derive=digests).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again."""
    return token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
