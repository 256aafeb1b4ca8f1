"""Command line: ``iterate`` splits and joins records, ``csv`` turns delimited rows into JSON Lines."""

from __future__ import annotations

import argparse
import importlib.util
import os
import sys
import tempfile
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.operators.jsonl import to_json_rows
from linewright.session import local_session
from linewright.sources import files, sinks


def _load(path: str) -> Any:
    spec = importlib.util.spec_from_file_location("linewright_user", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def _common(parser: argparse.ArgumentParser) -> None:
    flag = {"action": argparse.BooleanOptionalAction}
    parser.add_argument("source", nargs="?", default="-")
    parser.add_argument("destination", nargs="?", default="-")
    parser.add_argument("-s", "--split", default="\n", help="delimiter to split on")
    parser.add_argument("-j", "--join", default="\n", help="delimiter to join with")
    parser.add_argument("-e", "--skip-empty", default=True, **flag)
    parser.add_argument("-t", "--take", type=int)
    parser.add_argument("-p", "--drop", type=int, default=0)
    parser.add_argument("-v", "--debug", default=False, **flag)
    parser.add_argument("-w", "--reader-high-water-mark", type=int, default=65536)
    parser.add_argument("-W", "--writer-high-water-mark", type=int, default=262144)
    parser.add_argument("-f", "--filter", help="Python file with filter(Column or row columns) -> Column")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linewright")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("iterate", help="split and join records")
    _common(one)
    one.add_argument("-T", "--transformer", help="Python file with transform(Column) -> Column")
    two = commands.add_parser("csv", help="delimited rows to JSON Lines")
    _common(two)
    two.add_argument("--header", default=True, action=argparse.BooleanOptionalAction)
    two.add_argument("--transformers", help="Python file with a dict `transformers` of name -> Column function")
    two.add_argument("-c", "--column-delimiter", default=",")
    two.add_argument("-m", "--mode", default="object", choices=("object", "array", "entries"))
    two.add_argument("-q", "--quotes", default=False, action=argparse.BooleanOptionalAction)
    return top


def _unescape(text: str) -> str:
    return {"\\n": "\n", "\\t": "\t", "\\r\\n": "\r\n", "\\r": "\r", "\\0": "\0"}.get(text, text)


def _emit(df: DataFrame, args: argparse.Namespace, stdout: TextIO) -> None:
    """To one file, written by the tasks, or to standard output, pipes and devices: these are the driver's, to which
    partitions come one at a time. So they do without a text between records, which Spark's writer refuses."""
    # As the driver would read them, so a file holds what standard output shows.
    df = df.select(F.make_valid_utf8("value").alias("value"))
    if args.debug:
        df.explain("formatted")
    plain = not os.path.exists(args.destination) or os.path.isfile(args.destination)
    if args.destination != "-" and plain and _unescape(args.join):
        sinks.write_file(df, args.destination, delimiter=_unescape(args.join))
        return
    out = stdout if args.destination == "-" else open(args.destination, "w", encoding="utf-8", newline="")
    try:
        for row in df.toLocalIterator(prefetchPartitions=True):
            out.write(row["value"])
            out.write(_unescape(args.join))
        out.flush()
    finally:
        if out is not stdout:
            out.close()


def run(argv: list[str], spark: SparkSession | None = None, stdin=None, stdout: TextIO | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or local_session(os.cpu_count() or 1)
    spooled = None
    if args.source == "-":
        spooled = tempfile.NamedTemporaryFile(delete=False)
        spooled.write((stdin or sys.stdin.buffer).read())
        spooled.close()
        args.source = spooled.name
    keep: Callable = _load(args.filter).filter if args.filter else lambda *_: F.lit(True)
    try:
        if args.command == "iterate":
            rows = files.read_delimited(spark, args.source, _unescape(args.split), skip_empty=args.skip_empty, drop=args.drop, take=args.take)
            transform = _load(args.transformer).transform if args.transformer else lambda c: c
            # The filter sees the record as it was read.
            rows = rows.where(keep(F.col("value"))).orderBy("_file", "_pos").select(transform(F.col("value")).cast("string").alias("value"))
        else:
            transformers = _load(args.transformers).transformers if args.transformers else None
            shaped = files.read_csv(spark, args.source, header=args.header, mode=args.mode, column_delimiter=_unescape(args.column_delimiter), quotes=args.quotes, transformers=transformers, drop=args.drop, take=args.take, delimiter=_unescape(args.split), skip_empty=args.skip_empty)
            names = [c for c in shaped.columns if c not in ("_file", "_pos")]
            shaped = shaped.where(keep({n: F.col(f"`{n}`") for n in names})) if args.filter else shaped
            ordered = shaped.orderBy("_file", "_pos").select(*[f"`{n}`" for n in names])
            rows = to_json_rows(ordered) if args.mode == "object" else ordered.select(F.to_json("row").alias("value"))
        _emit(rows.where("value is not null"), args, stdout or sys.stdout)
    finally:
        if spooled:
            os.unlink(spooled.name)


def main() -> None:
    run(sys.argv[1:])
