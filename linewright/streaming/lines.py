"""Structured Streaming: delimited records from a folder that files arrive in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linewright.functions.delimiters import Delimiter, parse_delimiter
from linewright.operators import records, tabular


def read_stream(spark: SparkSession, path: str, delimiter: Delimiter = "\n", *, skip_empty: bool = True, crlf: bool = False, quotes: bool = False, drop: int = 0, take: int | None = None, max_files: int | None = None) -> DataFrame:
    """An unbounded DataFrame with the records of every file of ``path`` in ``value``.

    ``quotes``, ``crlf``, ``drop`` and ``take`` need a file as a whole: its records then bear their number in ``pos``,
    and a task holds one file at a time. Plain lines are read in splits.
    """
    if quotes or crlf or drop or take is not None:
        docs = read_documents(spark, path, max_files=max_files)
        return records.split_records(docs, "value", delimiter, skip_empty=skip_empty, crlf=crlf, quotes=quotes, drop=drop, take=take)
    rows = _limited(spark, max_files).option("lineSep", parse_delimiter(delimiter)).load(path)
    return rows.where(F.octet_length("value") > 0) if skip_empty else rows


def _limited(spark: SparkSession, max_files: int | None):
    reader = spark.readStream.format("text")
    return reader.option("maxFilesPerTrigger", max_files) if max_files else reader


def read_documents(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """An unbounded DataFrame with the text of every file of ``path`` in ``value``."""
    return _limited(spark, max_files).option("wholetext", True).load(path)


def read_csv_stream(spark: SparkSession, path: str, *, names: list[str] | None = None, mode: str = "object", max_files: int | None = None, **options) -> DataFrame:
    """Shaped rows of every file that arrives, with the options of :func:`~linewright.operators.tabular.parse_documents`.

    A stream has one schema from the start: objects need ``names``, and have those columns; ``ragged`` is "drop" or "map".
    """
    if mode == "object" and names is None and options.get("ragged") != "map":
        raise ValueError("objects of a stream need the names of their columns")
    if mode == "object":
        options = {"ragged": "drop"} | options
    return tabular.parse_documents(read_documents(spark, path, max_files=max_files), "value", mode=mode, names=names, **options)


def split_stream(chunks: DataFrame, column: str, delimiter: Delimiter = "\n", **options) -> DataFrame:
    """Splits each chunk of a stream on its own, with the options of :func:`~linewright.operators.records.records`."""
    parts = records.split_records(chunks.select(column), column, delimiter, **options)
    return parts.select("value")


def write_stream(rows: DataFrame, path: str, checkpoint: str, *, delimiter: str = "\n") -> StreamingQuery:
    """Writes what has arrived so far as text files and stops."""
    return rows.select("value").writeStream.format("text").option("lineSep", delimiter).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def each_batch(rows: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """``handle`` gets every micro-batch: the place for what streams cannot do themselves, such as drop."""
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
