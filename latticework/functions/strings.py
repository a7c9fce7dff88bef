"""Fixed-size strings and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_terminated(s: Column) -> Column:
    """What stands before the first NUL."""
    return F.substring_index(s, "\0", 1)


def null_padded(s: Column) -> Column:
    """Without NULs at the end."""
    return F.rtrim(s, F.lit("\0"))


def space_padded(s: Column) -> Column:
    """Without spaces at the end."""
    return F.rtrim(s)


def member_padded(s: Column) -> Column:
    """Without spaces and NULs at the end, as in records."""
    return F.rtrim(s, F.lit(" \0"))


def fixed_width(s: Column, width: int) -> Column:
    """The UTF-8 bytes of a text cut, or filled up with NULs, to a width; a cut may split a character."""
    data = F.encode(s, "utf-8")
    fill = F.repeat(F.lit("\0"), F.greatest(F.lit(width) - F.octet_length(data), F.lit(0))).cast("binary")
    return F.concat(F.substring(data, 1, width), fill)


def parent_path(path: Column) -> Column:
    """The path of a path's group; the root's own is empty."""
    bare = F.rtrim(path, F.lit("/"))
    return F.when(bare == "", "").otherwise(F.regexp_replace(F.regexp_extract(bare, "^(.*/)[^/]*$", 1), "(.)/$", "$1"))


def base_name(path: Column) -> Column:
    """The last part of a path; the root has none."""
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def path_problem(path: Column) -> Column:
    """What is wrong with the path of a new object; null if nothing."""
    return (
        F.when(path.isNull() | (path == ""), "empty path")
        .when(~path.startswith("/"), "path must start with /")
        .when(path == "/", "root exists already")
        .when(path.contains("//"), "path has empty parts")
    )


def external_file_problem(name: Column) -> Column:
    """What is wrong with the file name of an external link; null if nothing."""
    return F.when(name.isNull() | (name == ""), "empty file name").when(F.array_contains(F.split(name, "/"), ".."), "file name leaves its folder").when(F.octet_length(name) > 65535, "file name too long")


def in_unit(n: Column, bits: int, digits: int, unit: str) -> Column:
    """A size in units of 2^bits bytes, its double rounded exactly and halves to the even digit, as C and Go print it; format_string would round halves up."""
    return F.concat(F.call_function("format_number", n / (1 << bits), F.lit(f"0.{'0' * digits}")), F.lit(f" {unit}"))


def readable_bytes(n: Column) -> Column:
    """A size as B, KB, MB or GB; null if there is none."""
    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, in_unit(n, 10, 1, "KB"))
        .when(n < 1 << 30, in_unit(n, 20, 1, "MB"))
        .otherwise(in_unit(n, 30, 2, "GB"))
    )
