"""Delimiter-aligned byte ranges: of files, and of text columns."""

from __future__ import annotations

import math

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.delimiters import Delimiter, delimiter_bytes, parse_delimiter
from linewright.functions.exprs import let


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def file_size(path: str) -> int:
    fs, p = open_path(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.size


def read_bytes(path: str, start: int, length: int) -> bytes:
    """``length`` bytes from ``start``; fewer at the end of the file."""
    fs, p = open_path(path)
    with fs.open_input_file(p) as f:
        return f.read_at(max(0, min(length, f.size() - start)), start) if start < f.size() else b""


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def compute_segments(path: str, concurrency: int, delimiter: Delimiter = "\n", probe_size: int = 65536) -> list[tuple[int, int]]:
    """Up to ``concurrency`` ranges that cover the file; each but the last ends behind a delimiter.

    The delimiter is looked for in ``probe_size`` bytes from each ideal cut; where there is none the
    two ranges stay one. An empty file has no range.
    """
    needle = delimiter_bytes(delimiter)
    n, parts = file_size(path), max(1, math.floor(concurrency))
    borders = {0, n}
    for k in range(1, parts):
        cut = half_up(k * n / parts)
        if 0 < cut < n:
            found = read_bytes(path, cut, probe_size).find(needle)
            end = cut + found + len(needle)
            if found >= 0 and end < n:
                borders.add(end)
    ordered = sorted(borders)
    return list(zip(ordered, ordered[1:], strict=False))


def text_segments(value: Column, parts: int, delimiter: Delimiter = "\n") -> Column:
    """The same ranges of an ASCII-delimited text column, as (start, end) in characters; the probe is the whole rest."""
    d = parse_delimiter(delimiter)

    def cut(n: Column, k: int) -> Column:
        at = F.floor(F.lit(k) * n / F.lit(float(parts)) + 0.5).cast("int")
        # With the position as a column: locate() from the first character at or behind the ideal cut.
        found = F.struct(at.alias("at"), F.call_function("locate", F.lit(d), value, at + 1).alias("found"))
        return let(found, lambda f: F.when((f["at"] > 0) & (f["at"] < n) & (f["found"] > 0) & (f["found"] - 1 + len(d) < n), f["found"] - 1 + len(d)))

    def ranges(n: Column) -> Column:
        borders = F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit(0), n, *[cut(n, k) for k in range(1, parts)]))))
        pairs = let(borders, lambda bs: F.transform(F.slice(bs, F.lit(1), F.size(bs) - 1), lambda s, i: F.struct(s.cast("long").alias("start"), F.get(bs, i + 1).cast("long").alias("end"))))
        return F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))

    return let(F.length(value), ranges)


def split_segments(df: DataFrame, column: str, parts: int, delimiter: Delimiter = "\n") -> DataFrame:
    """A row for each segment of ``column``: segment, byte range in characters and its text in ``part``."""
    others = [c for c in df.columns if c != column]
    rows = df.select(*others, column, F.posexplode(text_segments(F.col(column), parts, delimiter)).alias("segment", "_r"))
    part = F.substring(F.col(column), (F.col("_r.start") + 1).cast("int"), (F.col("_r.end") - F.col("_r.start")).cast("int"))
    return rows.select(*others, F.col("segment").cast("long").alias("segment"), F.col("_r.start").alias("start"), F.col("_r.end").alias("end"), part.alias("part"))
