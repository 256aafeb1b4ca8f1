"""Records of text columns: splitting with every option, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.functions import exprs
from linewright.functions.delimiters import Delimiter, delimiter_bytes, parse_delimiter


def records(value: Column, delimiter: Delimiter = "\n", *, skip_empty: bool = True, drop: int = 0, take: int | None = None, crlf: bool = False, quotes: bool = False, position: int = 0) -> Column:
    """The records of ``value`` as an array.

    ``position`` is the byte to start at. A carriage return before a matched delimiter goes with
    ``crlf``; empty records go next; ``drop`` and ``take`` count what is left.
    """
    d = parse_delimiter(delimiter)
    if position:
        value = F.substring(value.cast("binary"), position + 1, 2**31 - 1).cast("string")
    parts = exprs.split(value, d, quotes)
    if crlf:
        parts = exprs.trim_returns(parts)
    if skip_empty:
        parts = F.filter(parts, lambda v: F.octet_length(v) > 0)
    drop, take = max(drop, 0), None if take is None else max(take, 0)
    if drop or take is not None:
        parts = F.slice(parts, F.lit(drop + 1), F.lit(2**31 - 1 - drop if take is None else take))
    return parts


def split_records(df: DataFrame, column: str, delimiter: Delimiter = "\n", *, pos: str = "pos", value: str = "value", **options) -> DataFrame:
    """A row for each record, its number in ``pos`` (among the emitted ones, from 0), its text in ``value``.

    Of a BINARY column the records are BINARY, too, and the delimiter may be any bytes.
    """
    others = [c for c in df.columns if c not in (column, pos, value)]
    if isinstance(df.schema[column].dataType, T.BinaryType):
        # As Latin-1 every byte is a character.
        parts = records(F.decode(F.col(column), "ISO-8859-1"), delimiter_bytes(delimiter).decode("latin-1"), **options)
        parts = F.transform(parts, lambda p: F.encode(p, "ISO-8859-1"))
    else:
        parts = records(F.col(column), delimiter, **options)
    return df.select(*others, F.posexplode(parts).alias(pos, value)).withColumn(pos, F.col(pos).cast("long"))


def byte_ranges(df: DataFrame, column: str, delimiter: Delimiter = "\n") -> DataFrame:
    """A row for each range between delimiters: pos, byte_start, byte_end (exclusive) and value, empty ones included.

    The offsets are made within the row; nothing is shuffled.
    """
    d = parse_delimiter(delimiter)
    others = [c for c in df.columns if c not in (column, "pos", "byte_start", "byte_end", "value")]
    zipped = F.arrays_zip(exprs.byte_ranges(F.col(column), d).alias("r"), exprs.split_plain(F.col(column), d).alias("value"))
    rows = df.select(*others, F.posexplode(zipped).alias("pos", "_z"))
    return rows.select(*others, F.col("pos").cast("long").alias("pos"), F.col("_z.r.start").alias("byte_start"), F.col("_z.r.end").alias("byte_end"), F.col("_z.value").alias("value"))


def logical_rows(lines: DataFrame, order: list[str], group: list[str], value: str = "value") -> DataFrame:
    """Physical lines joined to rows whose quotes are closed, within each ``group``.

    A line starts a row iff the quotes before it in its group are even. For one large file use
    :func:`linewright.sources.files.read_rows`, which needs no window over the file.
    """
    quotes = F.length(value) - F.length(F.replace(F.col(value), F.lit('"'), F.lit("")))
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    starts = lines.withColumn("_q", quotes).withColumn("_s", (F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2 == 0).cast("long"))
    rows = starts.withColumn("row", F.sum("_s").over(upto) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda s: s[value]), "\n")
    return rows.groupBy(*group, "row").agg(joined.alias(value))
