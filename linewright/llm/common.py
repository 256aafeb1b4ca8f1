"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.session import ship_package

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: The same, and turns every ASCII byte that is neither letter nor digit into a space.
#: Bytes from 0x80 stay, so a word is a run of [^\x00-\x2F\x3A-\x60\x7B-\x7F] over the code points too.
WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in LOWER)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_TURN: list = ["", lambda: None]


def take_turn(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Says which operator this Python worker serves now; what another one remembers there is cleared.

    Workers serve one task after the other, of any operator; their memories must not add up.
    """
    if _TURN[0] != owner:
        _TURN[1]()
        _TURN[:] = [owner, clear]
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: the allocators of idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text):
    """The column with A-Z lower-cased and everything else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def drop_clashing(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns called like one of ``names``, in any case: an operator's own columns win."""
    taken = {n.lower() for n in names}
    return df.drop(*[df[c] for c in df.columns if c.lower() in taken]) if any(c.lower() in taken for c in df.columns) else df


#: 64-bit words of the bitmap that :func:`likely_among` broadcasts, at most.
BITMAP_WORDS = 1 << 19


def likely_among(df: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``column`` is likely among the ``ids`` (one column); with ``how`` "left_anti" all others.

    No row of ``df`` is shuffled: a bitmap of the ids' hashes is broadcast, of ``BITMAP_WORDS`` words at most for any
    number of ids. No id is missed; rows that share a bit with one come along, so an exact join is to follow, of fewer
    rows. Rows without an id are never among them.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(64 * BITMAP_WORDS))
    word, bit = (lambda p: F.shiftrightunsigned(p, 6)), (lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int")))
    set_bits = ids.select(place(F.col(ids.columns[0])).alias("p")).groupBy(word(F.col("p")).alias("w")).agg(F.bit_or(bit(F.col("p"))).alias("b"))
    own = place(df[column])
    return df.join(F.broadcast(set_bits), df[column].isNotNull() & (set_bits["w"] == word(own)) & (set_bits["b"].bitwiseAND(bit(own)) != 0), how)


def add_columns(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], fields: list[T.StructField], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns that ``fn`` makes for every Arrow batch.

    ``fn`` gets an iterator of batches and yields (batch, list of arrays) pairs.
    Input columns with the name of a new one give way to it.
    """
    ship_package(df.sparkSession)
    names = [f.name for f in fields]
    taken = {n.lower() for n in names}
    kept = [c for c in (keep if keep is not None else df.columns) if c.lower() not in taken]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + fields)
    kept = [f.name for f in schema.fields[: -len(fields)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, arrays in fn(batches):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + arrays, names=kept + names)
        give_back()

    return df.mapInArrow(run, schema)


def raw_texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    column = batch.column(name)
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind), True)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values of an array of integers, by sorting: quicker here than numpy's own hashing."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values
