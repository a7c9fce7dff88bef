import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def document_rows(seed=5, n=60):
    """Documents with copies, near copies, nulls in every column, empty, tiny and long texts, and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = []
    for i in range(n):
        text = "\n".join(line(rng.randint(3, 12)) for _ in range(rng.randint(1, 8)))
        rows.append([i * 3, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "c", "c", None]), len(text)])
    base = rows[0][1]
    rows += [[1000 + k, base, "en", "c", len(base)] for k in range(6)]
    rows += [[1100 + k, base + " tail" * (k + 1), "en", "c", None] for k in range(4)]
    rows += [[2000, None, "en", "a", None], [2001, "", None, None, 0], [2002, " \n\t ", "fr", "b", 4], [2003, "one", "en", "a", 3], [2004, "one two", "en", "a", 7], [2005, "12 34 !!", "en", "c", 8]]
    rows += [[2100, "word " * 20_000, "en", "b", 100_000], [None, "no id here at all", "fr", "a", 17], [None, None, None, None, None]]
    rows += [list(rows[3]), list(rows[3]), list(rows[-1]), [2001, "", None, None, 0]]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return document_rows()


@pytest.fixture(scope="session")
def folder(spark, rows, tmp_path_factory):
    """A table folder: documents with columns that other code might use itself, and pages."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("row", "size", "fp", "key", "slot", "shard", "_id", "_doc", "bpe", "_lines", "_dropped", "line_counts", "place", "target", "answer", "words"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    long = "<p>" + "x" * 1500 + "</p>"
    pages = [(i, f"http://h{i % 3}.example/{i}", long if i % 4 == 0 else f"<p>{i}</p>") for i in range(24)] + [(100, None, None), (101, "http://e.example", ""), (102, "u", long + "é\r\n\r\nWARC/1.1\r\n"), (None, "n", "y" * 1200), (103, "dup", "z" * 1000), (103, "dup", "z" * 1000), (104, "é\r\nX: y", "z" * 999)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at
