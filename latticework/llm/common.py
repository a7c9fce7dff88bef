"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import scratch as scratch
from ..plans.session import shared_folder

#: The white space that separates words: space and the bytes 9 to 13.
BLANKS = " \t\n\x0b\f\r"
#: One word, and what stands between words, as regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows and bytes that Python workers get at once.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    An expression that stands inside a lambda would otherwise be inlined there
    and evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def text_words(text: Column) -> Column:
    """The words of a text in order, as an array; none for an empty or null text."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, GAP)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES bytes from now on, so that Python's share of memory stays small however long texts are."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def power_of_two(n: float, most: int) -> int:
    """The smallest power of two that is at least ``n``, within 1 and ``most``."""
    p = 1
    while p < n and p < most:
        p *= 2
    return p


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores after it as no column has (columns differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def wrapped(df: DataFrame) -> DataFrame:
    """All columns of ``df`` as the one column ``_doc``, so that no other name can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_doc"))


def unwrapped(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that wrapped() put into ``_doc``, some replaced or added."""
    kept = [changed.get(c, F.col("_doc")[c]).alias(c) for c in columns]
    return df.select(*kept, *[v.alias(c) for c, v in changed.items() if c not in columns])
