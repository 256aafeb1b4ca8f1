"""Composite buffers: an ARRAY<BINARY> column of contiguous chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat(chunks: Column) -> Column:
    """All bytes as one BINARY; of no chunk the empty one."""
    return F.aggregate(chunks, F.lit(b""), lambda a, c: F.concat(a, c))


def byte_length(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0).cast("long"), lambda n, c: n + F.octet_length(c))


def append(chunks: Column, chunk: Column) -> Column:
    return F.concat(chunks, F.array(chunk))


def prepend(chunks: Column, chunk: Column) -> Column:
    return F.concat(F.array(chunk), chunks)


def remove_first(chunks: Column) -> Column:
    return F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))


def remove_last(chunks: Column) -> Column:
    return F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))


def byte_at(value: Column, index: Column | int) -> Column:
    """The byte at ``index`` as a number; an index outside raises."""
    i = F.lit(index) if isinstance(index, int) else index
    got = F.conv(F.hex(F.substring(value, i + 1, F.lit(1))), 16, 10).cast("int")
    return F.when((i >= 0) & (i < F.octet_length(value)), got).otherwise(F.raise_error(F.lit("index out of range")).cast("int"))


def subarray(value: Column, start: int, end: int | None = None) -> Column:
    """Bytes [start, end); bounds outside raise."""
    size = F.octet_length(value)
    stop = size if end is None else F.lit(end)
    ok = (F.lit(start) >= 0) & (F.lit(start) <= stop) & (stop <= size)
    return F.when(ok, F.substring(value, F.lit(start + 1), stop - start)).otherwise(F.raise_error(F.lit("range out of bounds")).cast("binary"))


def slice_bytes(value: Column, start: int, end: int | None = None) -> Column:
    """Bytes [start, end) with negative bounds counted from the end; bounds are clamped."""
    size = F.octet_length(value)
    bound = lambda n: F.least(size, F.lit(n)) if n >= 0 else F.greatest(size + n, F.lit(0))
    a, b = bound(start), size if end is None else bound(end)
    return F.substring(value, a + 1, F.greatest(b - a, F.lit(0)))


def read_window(value: Column, position: int, length: int) -> Column:
    """``length`` bytes from ``position``, fewer at the end."""
    return slice_bytes(value, position, position + length)


def grow(value: Column, size: int) -> Column:
    """Zero bytes behind ``value`` up to ``size``; longer values stay."""
    return F.when(F.octet_length(value) < size, F.concat(value, F.substring(F.lit(bytes(size)), F.lit(1), F.lit(size) - F.octet_length(value)))).otherwise(value)


def compress(value: Column, start: int, end: int | None = None) -> Column:
    """Only the bytes [start, end) that are still needed."""
    return slice_bytes(value, start, end)


def clear(value: Column) -> Column:
    """As many zero bytes."""
    return F.unhex(F.repeat(F.lit("00"), F.octet_length(value)))


def set_bytes(value: Column, data: Column, offset: int) -> Column:
    """``data`` written over ``value`` from ``offset``; it must fit."""
    fits = F.octet_length(data) + offset <= F.octet_length(value)
    made = F.concat(slice_bytes(value, 0, offset), data, F.substring(value, F.octet_length(data) + offset + 1, F.octet_length(value)))
    return F.when(fits, made).otherwise(F.raise_error(F.lit("range out of bounds")).cast("binary"))
