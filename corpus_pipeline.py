"""A corpus pipeline: language ID, line dedup, near-dedup, source mixing, token encoding.

Each stage takes the documents that the stage before it kept, written as Parquet
and read again, and works on all of them. All but the last return the columns of
``documents``. ``run`` writes the tables between the stages to the folder that
the cluster shares for checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.bpe import token_digests
from latticework.llm.common import free_name, scratch
from latticework.llm.langid import known_language
from latticework.llm.line_dedup import drop_boilerplate
from latticework.llm.mixing import mix_documents
from latticework.llm.simhash import drop_near_copies


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from the labelled ones; others go.

    Null texts and texts without letters go. Nothing is learned from null
    languages or ids; where nothing is learned all documents go. Of an empty table
    nothing is left. Equal texts go or stay together; very long ones are looked at
    in pieces; columns of any name are kept.
    """
    return known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; ``n_chars`` follows a text that changes.

    A line goes if more than a tenth, and more than one, of its source's documents
    have it, so that a source's only document stays as it is. A null source is one
    of its own; null texts stay null, and a text all of whose lines go is empty.
    Repeated rows count each; columns of any name are kept; an empty table stays so.
    """
    counts = free_name(docs.columns, "line_counts")
    clean = drop_boilerplate(docs, min_pages=2, counts=counts)
    chars = F.when(F.col(f"{counts}.dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", chars).drop(counts).select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate group.

    Groups are linked by SimHash within 2 bits, and by MinHash likeness where five-word
    shingles resemble each other by 0.8 or more. Null and empty texts and those
    without words are one group; null ids are last in their group, ordered by a
    hash of the text; of rows equal in id and text one stays. Columns of any name
    are kept; an empty table stays so.
    """
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: in a pass through a source, if it takes at least half of the words.

    Documents without words, null texts too, are never taken; a null source is one
    of its own; rows that are equal in id, source and text share what is taken of
    them. Columns of any name are kept; an empty table stays so.
    """
    return mix_documents(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the decoded bytes.

    One row for each row, repeated ones too; a null text is empty and has no
    tokens; long texts are cut where their pieces resynchronise.
    """
    return token_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

#: SimHash and the mix rest on XXH64, which SQL doesn't have; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
