"""Queues of half-open ranges: an ARRAY<STRUCT<start, end>> column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "array<struct<start:bigint,end:bigint>>"


def queue() -> Column:
    return F.array().cast(EMPTY)


def enqueue(ranges: Column, start: Column | int, end: Column | int) -> Column:
    bound = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    return F.concat(ranges, F.array(F.struct(bound(start).alias("start"), bound(end).alias("end"))))


def peek(ranges: Column) -> Column:
    """The first range; null if there is none."""
    return F.get(ranges, 0)


def peek_last(ranges: Column) -> Column:
    return F.get(ranges, F.size(ranges) - 1)


def dequeue(ranges: Column) -> Column:
    """What is left behind the first range."""
    return F.slice(ranges, F.lit(2), F.greatest(F.size(ranges) - 1, F.lit(0)))


def byte_length(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
