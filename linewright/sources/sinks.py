"""Writers of lines, JSON Lines and plain delimited text."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.operators.jsonl import to_json_rows
from linewright.session import drop_tables, scratch_path, shared_dir, ship_package

#: Bytes that a task copies into its place of a single file, about.
PIECE = 16 << 20


def _pieces(parts: list[tuple[str, int]], piece: int) -> list[list[tuple[str, int, int, int]]]:
    """The work of each task: (part, where in it, where in the whole file, bytes). Parts are cut at multiples of
    ``piece`` bytes of the whole file, and small ones go together."""
    groups, at = {}, 0
    for name, size in parts:
        start = 0
        while start < size:
            n = min(piece - (at + start) % piece, size - start)
            groups.setdefault((at + start) // piece, []).append((name, start, at + start, n))
            start += n
        at += size
    return list(groups.values())


def _copy(group: list[tuple[str, int, int, int]], target: str) -> None:
    with open(target, "r+b") as out:
        for name, start, at, n in group:
            with open(name, "rb") as part:
                part.seek(start)
                out.seek(at)
                while n:
                    data = part.read(min(n, 1 << 20))
                    if not data:
                        raise OSError(f"{name} is shorter than it was")
                    out.write(data)
                    n -= len(data)


def _join(spark: SparkSession, folder: str, target: str, piece: int = PIECE) -> None:
    """The parts that Spark wrote to ``folder``, in their order, as the file ``target``: local paths that all tasks see.

    Every task copies about ``piece`` bytes to their own place, the same ones if it runs again. Parts go once they are
    copied, so both take little more than one of them on the disk.
    """
    names = sorted((int(e.name.split("-")[1]), e.name) for e in os.scandir(folder) if e.name.startswith("part-"))
    parts = [(f"{folder}/{name}", os.path.getsize(f"{folder}/{name}")) for _, name in names]
    with open(target, "wb") as out:
        out.truncate(sum(size for _, size in parts))
    groups = _pieces(parts, piece)
    ship_package(spark)
    at_once = max(spark.sparkContext.defaultParallelism, len(groups) // 32)
    for k in range(0, len(groups), at_once):
        now = groups[k : k + at_once]
        spark.sparkContext.parallelize(now, len(now)).foreach(lambda group: _copy(group, target))
        left = {name for group in groups[k + at_once : k + at_once + 1] for name, *_ in group}
        for name in {name for group in now for name, *_ in group} - left:
            os.remove(name)


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme where it is one of files that driver and tasks open as such."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def write_lines(df: DataFrame, path: str, value: str = "value", *, delimiter: str = "\n", order: list | None = None, single: bool = False, mode: str = "errorifexists") -> None:
    """Each value and a delimiter behind it; empty values stay, null ones are left out.

    ``order`` sorts the rows over the files; ``single`` makes one file, in the order of the rows. In the files of a
    machine, shared ones too, any number of tasks write it; other stores take a file from one task only.
    """
    rows = df.where(F.col(value).isNotNull())
    if order:
        rows = rows.orderBy(*order)
    rows = rows.select(F.col(value).cast("string").alias("value"))
    local = local_path(df.sparkSession, path) if single else None
    there = local is not None and os.path.exists(local) and mode.lower() not in ("append", "overwrite")
    if local is None or there:  # Spark says what is to be done with a folder that is there
        (rows.coalesce(1) if single else rows).write.mode(mode).option("lineSep", delimiter).text(path)
        return
    parts, name = f"{os.path.dirname(local)}/.parts-{uuid.uuid4().hex}", f"part-00000-{uuid.uuid4()}-c000.txt"
    try:
        rows.write.mode(mode).options(lineSep=delimiter, compression="none").text(f"file://{parts}")
        if mode.lower() == "overwrite":
            drop_tables(df.sparkSession, [path])
        os.makedirs(local, exist_ok=True)
        _join(df.sparkSession, parts, f"{local}/_{name}")
        os.replace(f"{local}/_{name}", f"{local}/{name}")
        open(f"{local}/_SUCCESS", "w").close()
    finally:
        drop_tables(df.sparkSession, [f"file://{parts}"])


def _by_driver(spark: SparkSession, folder: str, target: str) -> None:
    """The parts of ``folder``, in their order, as a file of the driver's own; its JVM copies them."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    parts = hadoop.fs.Path(folder)
    fs = parts.getFileSystem(conf)
    names = [status.getPath().getName() for status in fs.listStatus(parts)]
    out = spark._jvm.java.io.FileOutputStream(target)
    try:
        for _, name in sorted((int(n.split("-")[1]), n) for n in names if n.startswith("part-")):
            source = fs.open(hadoop.fs.Path(parts, name))
            try:
                hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()


def write_file(df: DataFrame, path: str, value: str = "value", *, delimiter: str = "\n") -> None:
    """The same as :func:`write_lines`, in the order of ``df``, as the file ``path`` itself: one that the driver opens.

    What is there is overwritten, after all rows are known. Tasks write the file on one machine, and on more of them
    under ``spark.checkpoint.dir``. Elsewhere they don't see it: the driver copies what they wrote, a buffer at a time.
    """
    spark, path = df.sparkSession, os.path.realpath(path)
    seen = spark.sparkContext.master.split("[")[0] == "local"
    if not seen:
        shared = local_path(spark, shared_dir(spark))
        seen = shared is not None and path.startswith(os.path.realpath(shared) + "/")
    parts = f"file://{os.path.dirname(path)}/.parts-{uuid.uuid4().hex}" if seen else scratch_path(spark, "parts")
    try:
        rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("value"))
        rows.write.options(lineSep=delimiter, compression="none").text(parts)
        if seen:
            _join(spark, parts.removeprefix("file://"), path)
        else:
            _by_driver(spark, parts, path)
    finally:
        drop_tables(spark, [parts])


def write_jsonl(df: DataFrame, path: str, **options) -> None:
    write_lines(to_json_rows(df), path, **options)


def csv_lines(df: DataFrame, *columns: str, delimiter: str = ",", out: str = "value") -> DataFrame:
    """Cells joined without quoting; nulls become empty cells."""
    names = columns or df.columns
    return df.select(F.concat_ws(delimiter, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).alias(out))


def to_array(df: DataFrame, pos: str = "pos", value: str = "value") -> list:
    """All values in order, on the driver: for results that fit there."""
    return [r[0] for r in df.orderBy(pos).select(value).collect()]


def iterate(df: DataFrame, pos: str = "pos", value: str = "value") -> Iterator:
    """The same, a partition at a time."""
    for row in df.orderBy(pos).select(value).toLocalIterator(prefetchPartitions=True):
        yield row[0]


class NewlineWriter:
    """Lines into one file from the driver: each with a line feed behind it, empty ones kept.

        with NewlineWriter(path) as writer:
            writer.write("alpha")
    """

    def __init__(self, path: str):
        self._file = open(path, "w", encoding="utf-8", newline="")

    def write(self, line: str | bytes) -> None:
        self._file.write((line if isinstance(line, str) else line.decode("utf-8")) + "\n")

    def close(self) -> None:
        self._file.close()

    def __enter__(self) -> NewlineWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()
