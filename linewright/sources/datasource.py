"""A Python data source, ``delimited``: exact byte-range segments of files, a task for each.

    register(spark)
    spark.read.format("delimited").option("concurrency", 8).option("delimiter", "\\r\\n").load(path)

``path`` is a file, a folder or a glob; files come in the order of their names, each in up to
``concurrency`` segments. Rows are (segment INT, byte_start BIGINT, byte_end BIGINT, value BINARY);
bytes are not decoded, so any encoding comes through whole. Segments are numbered over all files, the
offsets are those of a row's own file. Options: delimiter, or delimiterHex for any bytes, concurrency,
probeSize, skipEmpty, crlf, and quotes, with which a file is one segment and delimiters inside quotes
end nothing.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from linewright.functions.delimiters import delimiter_bytes
from linewright.operators.segments import compute_segments, open_path
from linewright.session import ship_package

SCHEMA = "segment int, byte_start bigint, byte_end bigint, value binary"
#: Bytes read at a time.
HIGH_WATER_MARK = 1 << 20


class Segment(InputPartition):
    """``last`` says whether it is the last one of its file."""

    def __init__(self, number: int, path: str, start: int, end: int, last: bool):
        super().__init__(number)
        self.number, self.path, self.start, self.end, self.last = number, path, start, end, last


def files_of(path: str) -> list[str]:
    """The files that a path, a folder or a glob stands for, but for hidden ones, sorted."""
    fixed = path
    while any(c in fixed for c in "*?["):
        fixed = posixpath.dirname(fixed)
    fs, p = open_path(fixed)
    shown = lambda name: posixpath.basename(name)[:1] not in ("_", ".")
    uri = lambda name: fixed + name[len(p) :] if name.startswith(p) else name
    kind = fs.get_file_info(p).type
    if kind == pafs.FileType.File:
        return [path]
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    pattern = p + path[len(fixed) :] if fixed != path else None
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(p, recursive=pattern is not None)) if f.type == pafs.FileType.File and shown(f.path)]
    if pattern:
        # As in a shell a star does not reach over a slash; a folder that matches stands for its files.
        fits = lambda name: len(name.split("/")) == len(pattern.split("/")) and all(map(fnmatch.fnmatchcase, name.split("/"), pattern.split("/")))
        found = [f for f in found if fits(f) or fits(posixpath.dirname(f))]
    return sorted(map(uri, found))


def scan(path: str, start: int, end: int, needle: bytes, chunk: int = HIGH_WATER_MARK) -> Iterator[tuple[int, bytes]]:
    """(offset, record) for each record of the range, the one behind the last delimiter included."""
    fs, p = open_path(path)
    with fs.open_input_file(p) as f:
        at, read, rest = start, start, b""
        while read < end:
            data = f.read_at(min(chunk, end - read), read)
            if not data:
                break
            read += len(data)
            # What is left of the chunk before stays in front, so a delimiter may straddle chunks.
            parts = (rest + data).split(needle)
            for part in parts[:-1]:
                yield at, part
                at += len(part) + len(needle)
            rest = parts[-1]
        yield at, rest


def closed(records: Iterator[tuple[int, bytes]], needle: bytes) -> Iterator[tuple[int, bytes]]:
    """The records, those joined whose quotes are open in between."""
    start, held, odd = 0, [], False
    for at, raw in records:
        if not held:
            start = at
        held.append(raw)
        odd ^= raw.count(b'"') % 2 == 1
        if not odd:
            yield start, needle.join(held)
            held = []
    if held:
        yield start, needle.join(held)


class DelimitedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.needle = bytes.fromhex(options["delimiterhex"]) if "delimiterhex" in options else delimiter_bytes(options.get("delimiter", "\n"))
        self.quotes = options.get("quotes", "false").lower() == "true"
        if not self.needle or (self.quotes and b'"' in self.needle):
            raise ValueError("the delimiter is empty, or holds a quote")
        self.concurrency = int(options.get("concurrency", 1))
        self.probe = int(options.get("probesize", 65536))
        self.skip_empty = options.get("skipempty", "true").lower() == "true"
        self.crlf = options.get("crlf", "false").lower() == "true"

    def partitions(self) -> list[Segment]:
        out: list[Segment] = []
        for path in files_of(self.path):
            found = compute_segments(path, 1 if self.quotes else self.concurrency, self.needle, self.probe) or [(0, 0)]
            out += [Segment(len(out) + k, path, a, b, k == len(found) - 1) for k, (a, b) in enumerate(found)]
        return out or [Segment(0, "", 0, 0, False)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        rows, size = [], 0
        last = None
        records = scan(partition.path, partition.start, partition.end, self.needle)
        for at, raw in closed(records, self.needle) if self.quotes else records:
            if last is not None:
                size += self._add(rows, partition.number, *last, ended=True)
            last = (at, raw)
            if size > HIGH_WATER_MARK or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, size = [], 0
        # Behind the last delimiter of a segment that is not the file's last there is no record.
        if last is not None and (last[1] or partition.last):
            self._add(rows, partition.number, *last, ended=False)
        if rows:
            yield self._batch(rows)

    def _add(self, rows: list, number: int, at: int, raw: bytes, ended: bool) -> int:
        if ended and self.crlf and raw.endswith(b"\r"):
            raw = raw[:-1]
        if raw or not self.skip_empty:
            rows.append((number, at, at + len(raw), raw))
        return len(raw)

    def _batch(self, rows: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["segment", "byte_start", "byte_end", "value"])


class DelimitedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "delimited"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DelimitedReader:
        return DelimitedReader(dict(self.options))


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(DelimitedDataSource)
