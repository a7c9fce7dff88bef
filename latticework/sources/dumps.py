"""Bytes as hexadecimal lines, and text dumps of arrays as cell tables."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = re.compile(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?")


def hexdump(files: DataFrame, offset: int = 0, length: int = 256) -> DataFrame:
    """(path, at, hex, ascii) of each 16 bytes of a range; ``files`` has path and content, as Spark's binaryFile gives them."""
    data = F.substring(F.col("content"), offset + 1, length)
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("data") - 1, F.lit(0)), F.lit(16))
    lines = files.select("path", data.alias("data")).where(F.octet_length("data") > 0).select("path", "data", F.explode(starts).alias("at"))
    part = F.substring(F.col("data"), F.col("at") + 1, F.lit(16))
    return lines.select("path", (F.col("at") + offset).alias("at"), spaced_hex(part).alias("hex"), F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7E]", ".").alias("ascii"))


def spaced_hex(data: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.lower(F.hex(data)), "(..)", "$1 "))


def parse_dump(text: str) -> list[dict]:
    """The datasets of a text dump: name, type, extents, selection and values in the order printed."""
    out = []
    for m in re.finditer(r'DATASET\s+"([^"]*)"\s*\{', text):
        depth, at = 1, m.end()
        while depth and at < len(text):
            depth += {"{": 1, "}": -1}.get(text[at], 0)
            at += 1
        body = text[m.end() : at - 1]
        kind = re.search(r"DATATYPE\s+(H5T_\w+|H5T_STRING)", body)
        space = re.search(r"DATASPACE\s+(SIMPLE\s*\{\s*\(([^)]*)\)|SCALAR|NULL)", body)
        parts = {k.lower(): [int(v) for v in _NUMBER.findall(v)] for k, v in re.findall(r"(START|STRIDE|COUNT|BLOCK)\s*\(([^)]*)\)", body)}
        data = re.search(r"DATA\s*\{(.*?)\}", body, re.S)
        lines = re.sub(r"\([\d,]+\):", " ", data[1]) if data else ""
        values = re.findall(r'"(?:[^"\\]|\\.)*"', lines) if '"' in lines else [float(v) for v in _NUMBER.findall(lines)]
        dims = [int(v) for v in space[2].split(",")] if space and space[2] else None if space and space[1] == "NULL" else []
        out.append({"name": m[1], "type": kind[1] if kind else None, "dims": dims, "selection": parts, "values": [v[1:-1] if isinstance(v, str) else v for v in values]})
    return out


def read_dumps(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, type, dims, n, value) of the numeric datasets of text dumps, one row a value in printed order."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def rows(batches):
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                for d in parse_dump(text):
                    numbers = [v for v in d["values"] if not isinstance(v, str)]
                    if numbers:
                        yield pd.DataFrame({"file": file, "name": d["name"], "type": d["type"], "dims": [d["dims"]] * len(numbers), "n": range(len(numbers)), "value": numbers})

    return files.mapInPandas(rows, "file string, name string, type string, dims array<bigint>, n bigint, value double")
