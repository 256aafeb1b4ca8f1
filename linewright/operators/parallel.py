"""User functions over records, in Arrow batches."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from linewright.session import ship_package


class Context:
    """What a handler learns of a record: its number in the partition, and the partition."""

    __slots__ = ("index", "segment_index", "user_data")

    def __init__(self, index: int, segment_index: int, user_data: Any):
        self.index, self.segment_index, self.user_data = index, segment_index, user_data


class SKIP:
    """A handler returns this (the class) to leave a record out; None is a result like any other."""


class Aborted(RuntimeError):
    """The caller gave up."""


def map_records(df: DataFrame, value: str, handler: Callable[[Any, Context], Any], result_type: str, *, out: str = "result", user_data: Any = None, setup: Callable[[], Any] | None = None, max_in_flight: int = 8, abort: Callable[[], bool] | None = None) -> DataFrame:
    """A row (``out``) for each record that ``handler`` does not answer with SKIP; order is not kept.

    Values come and go as plain Python objects. ``setup`` runs once in each task before its records. A coroutine handler has ``max_in_flight``
    records under way at a time. An error in a handler fails the query, and what is under way is cancelled.
    ``abort`` is asked before each record; when it answers true, no further record of the task begins, those
    under way are cancelled and the query fails with :class:`Aborted`.
    """
    ship_package(df.sparkSession)
    narrow = df.select(value)
    asynchronous = inspect.iscoroutinefunction(handler)
    schema = T.StructType([T.StructField(out, T._parse_datatype_string(result_type))])
    made = to_arrow_type(schema[0].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        segment, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            items = [(x, Context(k, segment, user_data)) for k, x in enumerate(batch.column(0).to_pylist(), n)]
            n += len(items)
            results = asyncio.run(_gather(handler, items, max_in_flight, abort)) if asynchronous else [_ask(abort) or handler(*x) for x in items]
            yield pa.RecordBatch.from_arrays([pa.array([r for r in results if r is not SKIP], made)], names=[out])

    return narrow.mapInArrow(run, schema)


def _ask(abort: Callable[[], bool] | None) -> None:
    if abort is not None and abort():
        raise Aborted("aborted before all records were handled")


async def _gather(handler, items, limit: int, abort: Callable[[], bool] | None) -> list:
    gate = asyncio.Semaphore(max(1, limit))

    async def one(item):
        async with gate:
            _ask(abort)
            return await handler(*item)

    # The first failure cancels the others before it is raised.
    try:
        async with asyncio.TaskGroup() as group:
            tasks = [group.create_task(one(i)) for i in items]
    except ExceptionGroup as failures:
        raise failures.exceptions[0] from None
    return [t.result() for t in tasks]


def parallel_map(df: DataFrame, value: str, handler: Callable[[Any, Context], Any], result_type: str, *, concurrency: int | None = None, **options) -> DataFrame:
    """The same after dealing the rows over ``concurrency`` tasks, for handlers that cost more than the shuffle."""
    spread = df.select(value).repartition(max(1, int(concurrency))) if concurrency else df
    return map_records(spread, value, handler, result_type, **options)
