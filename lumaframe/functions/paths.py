"""Paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "."


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """The path without its last segment; the root for a path of one segment."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(ROOT))


def depth(path: Column) -> Column:
    """Slashes plus one: the root and the first level are both 1."""
    return F.size(F.split(path, "/")).cast("int")


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def ancestors(path: Column) -> Column:
    """Every folder above a path, the root included, as an array."""
    parts = F.split(path, "/")
    inner = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(ROOT)), inner)


def is_under(path: Column, folder: str | Column) -> Column:
    """Whether a folder path is the given folder or below it."""
    top = F.lit(folder) if isinstance(folder, str) else folder
    return (top == ROOT) | (path == top) | path.startswith(F.concat(top, F.lit("/")))


def escapes(path: Column) -> Column:
    """Whether any segment is '..'."""
    return F.exists(F.split(path, "/"), lambda s: s == "..")


def normalised(path: Column) -> Column:
    """Segments folded: '.' and empty ones go, '..' takes back one; NULL once that leaves the root."""
    start = F.array().cast("array<string>")
    left = F.array(F.lit(".."))
    fold = F.aggregate(
        F.split(path, "/"),
        start,
        lambda acc, s: F.when(F.get(acc, F.lit(0)) == "..", left)
        .when(s.isin("", "."), acc)
        .when(s != "..", F.concat(acc, F.array(s)))
        .when(F.size(acc) == 0, left)
        .otherwise(F.slice(acc, 1, F.size(acc) - 1)),
    )
    return F.when(F.get(fold, F.lit(0)) == "..", F.lit(None)).otherwise(F.array_join(fold, "/"))


def absolute(root: str, path: Column) -> Column:
    """The path under root, or root itself if the path leaves it."""
    inside = normalised(path)
    return F.when(inside.isNull() | (inside == ""), F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), inside))


def root_label(path: Column) -> Column:
    """The last segment only."""
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(name.isin("", "."), path).otherwise(name)


def csv_safe(text: Column) -> Column:
    """A quote in front of what a spreadsheet would take for a formula."""
    return F.when(F.substring(text, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), text)).otherwise(text)


def file_name(text: Column) -> Column:
    """A safe file name: 12 characters become '_', trimmed, at most 60 code points, never empty."""
    clean = F.substring(F.trim(F.translate(text, '\\/:*?"<>|\n\r\t', "_" * 12)), 1, 60)
    return F.when(clean == "", F.lit("export")).otherwise(clean)


def reviewer_name(text: Column) -> Column:
    """The trimmed name, or NULL unless it has 1 to 24 code points and no control character."""
    name = F.regexp_replace(text, r"^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$", "")
    return F.when(F.char_length(name).between(1, 24) & ~name.rlike(r"[\x00-\x1f\x7f-\x9f]"), name)


def export_name(folder: Column, kept: Column) -> Column:
    return F.concat(file_name(folder), F.lit("_保留"), kept.cast("string"), F.lit("个.zip"))


def cache_key(rel_path: Column, size: Column, mtime: Column, tag: str) -> Column:
    """SHA-1 of path, size, time and profile; a changed profile misses."""
    return F.sha1(F.concat_ws("|", rel_path, size.cast("string"), mtime.cast("string"), F.lit(tag)))


def cache_path(key: Column, ext: str) -> Column:
    return F.concat(F.substring(key, 1, 2), F.lit("/"), key, F.lit(f".{ext}"))
