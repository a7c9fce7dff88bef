"""A content-addressed archive of WARC records.

The archive is two tables. ``blobs`` has each payload once, under its SHA-256,
which is verified against the bytes when they are read. ``headers`` has each
record's exact header bytes (the WARC fields, the empty line, and the HTTP header
that its block begins with) and the digest of its payload. Original records, with
revisits resolved, are put together again by a join of the two.

Of records with equal payloads of at least ``LEAST`` bytes the one with the
largest id is written as a response, and the others as revisits that refer to
it; smaller payloads are always responses.

What a record is gets decided on ids and digests alone. A payload is packed once
in each task that meets it, so copies don't travel, and again only one of each
digest is kept. In the join of headers and blobs a hot digest's headers can be
split by adaptive execution, as both sides are plain exchanges of kept tables.

Header fields end at CR LF and nowhere else, so URLs may hold any other
character. A URL with CR or LF stands percent-encoded in its field, and its exact
bytes, in Base64, in a field of their own.

Defined results:

* null payloads count as empty; null ids sort before all others, and a record
  without id has the URI ``urn:page:`` followed by no number; null and empty URLs
  are read back as null;
* of rows with equal ids and payloads one is the response and the others are
  revisits of that id; every record has an id of its own all the same; other
  columns don't take part;
* a very long payload is one value in its row, as long as itself; an empty table
  gives an empty archive, from which no records are read;
* a header or payload that doesn't fit its digest or length raises an error.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, scratch, small_batches, table

LEAST = 1000
#: Every record has the same date, so that equal inputs make equal archives.
DATE = "2024-01-01T00:00:00Z"
#: Records in one WARC file.
FILE_RECORDS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: The field that has a URL's exact bytes if WARC-Target-URI can't.
EXACT_URL = "X-Target-URI-Base64"


def _uri(page_id: Column, sha1: Column, nth: Column | None = None) -> Column:
    """A record's id: that of its page, the payload's digest, and a number if rows repeat."""
    again = F.lit("") if nth is None else F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise("")
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit("/"), sha1, again, F.lit(">"))


def _http(size: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))


def _headers(kind: Column) -> Column:
    """A record's header bytes as they stand in the file: its fields, an empty line, and the HTTP header."""
    revisit, http = kind == "revisit", _http(F.col("size"))
    url = F.coalesce("url", F.lit(""))
    plain = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), _uri(F.col("page_id"), F.col("sha1"), F.col("nth"))),
        F.concat(F.lit("WARC-Target-URI: "), plain),
        F.when(plain != url, F.concat(F.lit(f"{EXACT_URL}: "), F.replace(F.base64(url.cast("binary")), F.lit("\r\n"), F.lit("")))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _uri(F.col("refers_to"), F.col("sha1")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit("\r\n"),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), http).cast("binary")


def _pack_once(batches):
    """(digest, packed) of payloads, each once for all batches of a task; what is kept is 32 bytes for each."""
    seen = set()
    for batch in batches:
        digests, packed = [], []
        for digest, data in zip(batch.column(0), batch.column(1), strict=True):
            key = bytes.fromhex(digest.as_py())
            if key not in seen:
                seen.add(key)
                digests.append(digest.as_py())
                packed.append(zlib.compress(data.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(packed, pa.binary())], names=["digest", "packed"])


@F.arrow_udf(T.BinaryType())
def _unpacked(data: pa.Array) -> pa.Array:
    return pa.array([None if x.as_py() is None else zlib.decompress(x.as_py()) for x in data], type=pa.binary())


def new_archive(spark: SparkSession) -> str:
    """A new place in the folder that all executors share."""
    return scratch(spark, "archive")


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> None:
    """Writes ``path/headers`` (digest, header) and ``path/blobs`` (digest, packed payload)."""
    small_batches(pages.sparkSession)
    data = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    captures = cut(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.sha2(data, 256).alias("digest"), F.sha1(data).alias("sha1"), F.octet_length(data).cast("long").alias("size")))
    # Each payload's largest id, and whether any row repeats.
    same = captures.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    best = cut(same.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.max("rows").alias("_rows")).withColumnRenamed("digest", "_digest"))

    met = captures.join(best, F.col("digest") == F.col("_digest")).drop("_digest")
    small, wins = F.col("size") < least, F.col("page_id").eqNullSafe(F.col("refers_to"))
    numbered = met.withColumn("nth", F.lit(1))
    if not best.where("_rows > 1").isEmpty():
        # Only payloads some row of which repeats are numbered.
        nth = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        numbered = numbered.where("_rows = 1").unionByName(met.where("_rows > 1").withColumn("nth", nth))
    kind = F.when(small | (wins & (F.col("nth") == 1)), "response").otherwise("revisit")
    numbered.withColumn("kind", kind).select("digest", _headers(F.col("kind")).alias("header")).write.parquet(f"{path}/headers")

    stored = pages.select(F.sha2(data, 256).alias("digest"), data.alias("data")).mapInArrow(_pack_once, "digest string, packed binary")
    stored.dropDuplicates(["digest"]).write.parquet(f"{path}/blobs")


def _field(lines: Column, name: str) -> Column:
    """The value of the first header line of this name; null if there is none or it is empty."""
    start = f"{name}: "
    found = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit(start))), F.lit(0))
    return F.nullif(F.substring(found, F.lit(len(start) + 1), F.length(found)), F.lit(""))


def _id_of(uri: Column) -> Column:
    return F.regexp_extract(uri, "^<urn:page:([^/]*)/.*>$", 1).try_cast("long")


def _url(lines: Column) -> Column:
    return F.coalesce(F.unbase64(_field(lines, EXACT_URL)).cast("string"), _field(lines, "WARC-Target-URI"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archive: what its header says, its payload, and its bytes as they stand in a WARC file.

    A record is its header followed by the payload that the join brings, unless it
    is a revisit, whose payload is given beside it. The size and digests are those
    of the bytes that were put together; a wrong digest or length, or a missing
    blob, raises an error.
    """
    small_batches(spark)
    blobs = spark.read.parquet(f"{path}/blobs").select(F.col("digest").alias("_digest"), "packed")
    rows = spark.read.parquet(f"{path}/headers").join(blobs, F.col("digest") == F.col("_digest"), "left").withColumn("payload", _unpacked(F.col("packed"))).drop("packed")
    # The fields end at the first empty line; what follows is the HTTP header.
    rows = rows.withColumn("lines", F.split(F.substring_index(F.col("header").cast("string"), "\r\n\r\n", 1), "\r\n"))
    lines = F.col("lines")
    rows = rows.select("digest", "header", "payload", "lines", _field(lines, "WARC-Type").alias("kind"), _field(lines, "Content-Length").cast("long").alias("length"))
    body = F.when(F.col("kind") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    rows = rows.withColumn("record", F.concat("header", body, F.lit(b"\r\n\r\n")))
    # A response's payload is read from its record: what is left of the block after the HTTP header.
    begin = F.octet_length("header")
    own = F.substring(F.col("record"), begin + 1, F.octet_length("record") - begin - 4)
    rows = rows.withColumn("payload", F.when(F.col("kind") == "revisit", F.col("payload")).otherwise(own))
    head = F.octet_length(F.array_join("lines", "\r\n")) + 4
    block = F.octet_length("record") - 4 - head
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("block", block.cast("long"))
    sound = (F.sha2("payload", 256) == F.col("digest")) & (_field(lines, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (F.col("length") == F.col("block"))
    checked = F.when(F.coalesce(sound, F.lit(False)), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("damaged record "), F.coalesce(_field(lines, "WARC-Record-ID"), F.lit("")))))
    return rows.select(
        _id_of(_field(lines, "WARC-Record-ID")).alias("page_id"),
        _url(lines).alias("url"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        checked.alias("payload_digest"),
        F.col("kind").alias("record_type"),
        _id_of(_field(lines, "WARC-Refers-To")).alias("refers_to"),
        "header",
        "payload",
        "record",
    )


def write_files(spark: SparkSession, path: str, to: str, records: int = FILE_RECORDS) -> None:
    """The archive's records as WARC files, of so many records each; payloads must be UTF-8 text."""
    rows = read_archive(spark, path).select(F.substring(F.col("record"), F.lit(1), F.octet_length("record") - 4).cast("string"))
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(to)


def parse_records(data: bytes):
    """(header fields, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        begin = end + 4
        at = begin + int(fields["Content-Length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of the record at byte {begin}")
        yield fields, data[begin:at]
        at += 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload) of the records of WARC files, one task a file.

    A revisit's payload is empty.
    """
    small_batches(spark)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "url", "exact", "record_type", "refers", "digest")] + [T.StructField("payload", T.BinaryType())])
    names = ("WARC-Record-ID", "WARC-Target-URI", EXACT_URL, "WARC-Type", "WARC-Refers-To", "WARC-Payload-Digest")

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                for fields, block in parse_records(data.as_py()):
                    yield pa.RecordBatch.from_arrays([*[pa.array([fields.get(n)], pa.string()) for n in names], pa.array([block.partition(b"\r\n\r\n")[2]], pa.binary())], names=schema.names)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)
    url = F.coalesce(F.unbase64("exact").cast("string"), F.nullif("url", F.lit("")))
    return rows.select(_id_of(F.col("id")).alias("page_id"), url.alias("url"), "record_type", _id_of(F.col("refers")).alias("refers_to"), F.substring_index("digest", ":", -1).alias("payload_digest"), "payload")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to an archive, and what is read back from it."""
    path = new_archive(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), best AS (
  SELECT payload_digest, max(page_id) AS best FROM p GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
  CASE WHEN p.payload_bytes < 1000 OR p.page_id = b.best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.payload_bytes < 1000 OR p.page_id = b.best THEN NULL ELSE b.best END AS refers_to
FROM p JOIN best b USING (payload_digest)
"""
