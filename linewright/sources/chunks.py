"""Raw byte chunks of files, and records from whatever holds them."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions.delimiters import Delimiter
from linewright.operators.records import split_records
from linewright.operators.segments import file_size, open_path
from linewright.session import ship_package
from linewright.sources.files import read_delimited

#: Bytes of a chunk.
HIGH_WATER_MARK = 65536


def iter_chunks(path: str, high_water_mark: int = HIGH_WATER_MARK, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """The bytes from ``start`` to ``end`` (inclusive; default the last), ``high_water_mark`` at a time."""
    fs, p = open_path(path)
    with fs.open_input_file(p) as f:
        stop = f.size() if end is None else min(f.size(), end + 1)
        for at in range(start, stop, high_water_mark):
            yield f.read_at(min(high_water_mark, stop - at), at)


def read_chunks(spark: SparkSession, path: str, high_water_mark: int = HIGH_WATER_MARK, start: int = 0, end: int | None = None) -> DataFrame:
    """(offset, bytes) of every chunk of a file from ``start`` to ``end`` (inclusive; default the last), read by the tasks."""
    if high_water_mark < 1 or start < 0:
        raise ValueError("chunks hold at least one byte and start at one")
    ship_package(spark)
    stop = file_size(path) if end is None else min(file_size(path), end + 1)

    def read(batches):
        fs, p = open_path(path)
        with fs.open_input_file(p) as f:
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([f.read_at(min(high_water_mark, stop - at), at)], pa.binary())], names=["offset", "bytes"])

    return spark.range(start, max(start, stop), high_water_mark).mapInArrow(read, "offset long, bytes binary")


def is_path(source: object) -> bool:
    return isinstance(source, (str, os.PathLike))


def is_content(source: object) -> bool:
    return isinstance(source, (bytes, bytearray, memoryview))


def parse_text(spark: SparkSession, content: str | bytes, delimiter: Delimiter = "\n", **options) -> DataFrame:
    """(pos, value) of the records of ``content`` itself. A path goes to :func:`records_from`."""
    text = content if isinstance(content, str) else bytes(content).decode("utf-8", "replace")
    return split_records(spark.range(1).select(F.lit(text).alias("_text")), "_text", delimiter, **options)


def records_from(spark: SparkSession, source: object, delimiter: Delimiter = "\n", **options) -> DataFrame:
    """Records of a path (str, PathLike, file: URL), of bytes, of an iterable of chunks, or of a DataFrame's column.

    A str is always a path; use :func:`parse_text` for text. A DataFrame has one column, a document in each row.
    """
    if isinstance(source, DataFrame):
        if len(source.columns) != 1:
            raise ValueError("name the column: select the one that holds the documents")
        return split_records(source, source.columns[0], delimiter, **options)
    if is_path(source):
        try:
            return read_delimited(spark, os.fspath(source), delimiter, **options)
        except Exception as error:
            raise OSError(f"cannot read {os.fspath(source)}") from error
    if is_content(source):
        return parse_text(spark, bytes(source), delimiter, **options)
    if isinstance(source, Iterable):
        return parse_text(spark, b"".join(c.encode() if isinstance(c, str) else bytes(c) for c in source), delimiter, **options)
    raise TypeError(f"no source of records: {type(source).__name__}")
