"""Language identification by bit-sliced Bloom filters over n-grams.

Training learns which n-grams the texts of each language contain. Each language has a bit;
slot i of the filter holds, bit-sliced, position i of all languages' Bloom
filters. So ANDing an n-gram's few slots returns all languages that contain it
at once. A text's n-grams give one popcount for each language. Each is corrected
for the share of n-grams that the language's filter lets through falsely (its
fill to the power of the number of slots), and the largest decides.

An n-gram is ``NGRAM`` bytes of the lower-cased UTF-8 text whose runs of other
characters than letters are one space.

The filter is fitted on a bounded sample of labelled texts: whole texts, in the
order of a hash of their ids, as many as have ``SAMPLE_CHARS`` characters together
for each language (fewer if all would have more than ``ALL_CHARS``). A text that
would go beyond that is passed over. The n-grams that the driver collects are no
more than those of this sample, and the filter's size is a parameter.

Defined results:

* null texts and texts without letters are ``und`` with score 0;
* a text none of whose n-grams is known gets the language that was most
  frequent in training, with score 0; ties go to the more frequent language;
* if nothing was learned every text is ``und``;
* equal texts have equal results; repeated rows and other columns are kept;
  a very long text is handled in pieces of ``AT_ONCE`` characters, cut between
  words; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, unwrapped, wrapped

NGRAM = 5
#: Characters of the training sample for each language and for all of them, and the most languages.
SAMPLE_CHARS, ALL_CHARS, MAX_LANGUAGES = 4_000_000, 16_000_000, 64
#: The draw has SAMPLE_CHARS characters on average; what goes beyond so many times that is left out.
SLACK = 2
#: Slots of the filter, and those that one n-gram sets.
SLOTS, HASHES = 1 << 23, 3
#: Characters of a text whose n-grams are looked up at once.
AT_ONCE = 1 << 16
UNKNOWN = "und"
#: Texts below this score are rejected as none of the learned languages, if they have enough characters to tell.
MIN_SCORE, MIN_CHARS = 0.25, 40

_OTHER = regex.compile(r"\P{L}+")
_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def normal_pieces(text: str, size: int):
    """The lower-cased UTF-8 bytes of a text, runs of other characters than letters as one space and one at either end, in pieces.

    A text is cut where other characters than letters begin, so that lower-casing
    sees whole words; a longer word makes a piece as long as itself.
    """
    at, space = 0, True
    yield b" "
    while at < len(text):
        met = _OTHER.search(text, at + size)
        end = met.start() if met else len(text)
        part = _OTHER.sub(" ", text[at:end].lower())
        at = end
        # A run of other characters that goes on over the cut is still one space.
        if space:
            part = part.lstrip(" ")
        if part:
            space = part.endswith(" ")
            yield part.encode("utf-8", "replace")
    if not space:
        yield b" "


def gram_pieces(text: str, size: int | None = None):
    """The n-grams of a text in order, as arrays of numbers, one array for each piece."""
    before, given = b"", False
    for piece in normal_pieces(text, size or AT_ONCE):
        data = before + piece
        n = len(data) - NGRAM + 1
        if n > 0:
            data_ = np.frombuffer(data, dtype=np.uint8)
            out = np.zeros(n, dtype=np.uint64)
            for k in range(NGRAM):
                out = (out << np.uint64(8)) | data_[k : k + n]
            given = True
            yield out
        before = data[max(0, n) :]
    if not given:
        # Fewer bytes than an n-gram: those that there are, and zeros.
        yield np.array([int.from_bytes(before.ljust(NGRAM, b"\0"), "big")], dtype=np.uint64)


def grams_of(text: str) -> np.ndarray:
    """The n-grams of a text in order, each as a number."""
    return np.concatenate(list(gram_pieces(text)))


def slots_of(grams: np.ndarray, slots: int) -> list[np.ndarray]:
    """The filter's slots of each n-gram, one array for each hash."""
    shift = np.uint64(64 - (slots.bit_length() - 1))
    mixed = (grams ^ (grams >> np.uint64(17))) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(32)
    return [(mixed * f) >> shift for f in _FACTORS[:HASHES]]


class Filters:
    """The filters of all languages; ``languages`` in the order of their frequency."""

    def __init__(self, languages: list[str], grams: list[np.ndarray], slots: int = SLOTS):
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(k).itemsize * 8 >= len(languages))
        self.languages, self.slots = languages, slots
        self.table, falsely = np.zeros(slots, dtype=kind), []
        for k, of in enumerate(grams):
            for at in slots_of(of, slots):
                self.table[at] |= kind(1 << k)
            falsely.append((np.count_nonzero(self.table & kind(1 << k)) / slots) ** HASHES)
        self.falsely = np.array(falsely)

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter has."""
        first, *rest = slots_of(grams, self.slots)
        found = self.table[first]
        for more in rest:
            found &= self.table[more]
        return np.array([np.count_nonzero(found & self.table.dtype.type(1 << k)) for k in range(len(self.languages))], dtype=np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        counts, total = np.zeros(len(self.languages), dtype=np.int64), 0
        for grams in gram_pieces(text):
            counts += self.counts(grams)
            total += len(grams)
        share = np.clip((counts / total - self.falsely) / (1 - self.falsely), 0.0, 1.0)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


_GRAMS = T.StructType([T.StructField("bit", T.LongType()), T.StructField("gram", T.LongType())])


def _distinct_grams(batches):
    """The n-grams of texts (bit of the language, text), each once for a language and batch."""
    for batch in batches:
        by: dict[int, list[np.ndarray]] = {}
        for bit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(bit, []).extend(map(np.unique, gram_pieces(text)))
        for bit, of in by.items():
            grams = np.unique(np.concatenate(of)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), bit)), pa.array(grams)], names=_GRAMS.names)


def train(labelled: DataFrame, key: str, text: str, lang: str, sample_chars: int = SAMPLE_CHARS) -> Filters:
    """Filters for the languages in ``lang``; rows with null in it, or in ``text``, aren't used."""
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = known.groupBy(lang).agg(F.sum(F.char_length(text)).alias("chars"), F.count(F.lit(1)).alias("texts")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sizes.sort(key=lambda r: (-r["texts"], r[0]))
    languages = [r[0] for r in sizes]
    if not languages:
        return Filters([], [])
    small_batches(labelled.sparkSession)
    sample_chars, part, bit = min(sample_chars, ALL_CHARS // len(languages)), F.lit(0.0), F.lit(0)
    for k, r in enumerate(sizes):
        part = F.when(F.col(lang) == r[0], min(1.0, sample_chars / max(1, r["chars"]))).otherwise(part)
        # As a signed number, like Spark's.
        bit = F.when(F.col(lang) == r[0], (1 << k) - (1 << 64 if k == 63 else 0)).otherwise(bit)
    spot = F.shiftrightunsigned(F.xxhash64(key), 32) / float(1 << 32)
    drawn = known.where(spot < part).select(bit.cast("long").alias("bit"), F.col(text).alias("text"), F.char_length(text).alias("chars"), F.xxhash64(key).alias("turn"))
    # So many rows are expected to have the sample's characters; the running sum makes that a bound.
    running = F.sum("chars").over(Window.partitionBy("bit").orderBy("turn", "chars", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sample = drawn.where(F.col("chars") <= sample_chars).withColumn("sum", running).where(F.col("sum") <= SLACK * sample_chars).select("bit", "text")
    # Each n-gram's languages as the bits of one number: no more rows than the sample has characters.
    found = sample.mapInArrow(_distinct_grams, _GRAMS).groupBy("gram").agg(F.bit_or("bit").alias("languages")).toArrow()
    gram, of = (found.column(k).combine_chunks().to_numpy(zero_copy_only=False).astype(np.uint64) for k in ("gram", "languages"))
    return Filters(languages, [gram[of >> np.uint64(k) & np.uint64(1) == 1] for k in range(len(languages))])


def predict(spark: SparkSession, filters: Filters, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    small_batches(spark)
    # The filter's size is a parameter: SLOTS times at most 8 bytes.
    shared = spark.sparkContext.broadcast(filters)

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id, as text, leaves 2 when divided by 4; not for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_documents(docs: DataFrame) -> Filters:
    return train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), "doc_id", "text", "lang")


def known_language(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that are in none of the languages learned from them."""
    text = F.col("_doc")["text"]
    out = wrapped(docs).withColumn("answer", predict(docs.sparkSession, train_on_documents(docs), text))
    likely = (F.col("answer.score") >= least) | (F.char_length(text) < MIN_CHARS)
    return unwrapped(out.where((F.col("answer.lang_pred") != UNKNOWN) & likely), docs.columns)


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    filters = train_on_documents(docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(spark, filters, F.col("text")).alias("answer"))
    return out.select("doc_id", "held_out", "answer.lang_pred", "answer.score")
