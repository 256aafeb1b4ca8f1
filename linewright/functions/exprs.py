"""Column expressions of the record and column grammar. All are native; none leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright.functions.delimiters import VISIBLE, pattern

QUOTE = '"'


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: inside a lambda an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def split_plain(value: Column, delimiter: str) -> Column:
    """All parts, empty ones and the trailing one included."""
    return F.split(value, pattern(delimiter), -1)


def split_quoted(value: Column, delimiter: str) -> Column:
    """Parts at delimiters outside quotes; every quote toggles, an unclosed one holds the rest.

    Each delimiter outside quotes becomes a mark of two characters, an escape and a sign. An escape that
    the value itself holds is first followed by another sign, so marks are never mistaken, whatever the value.
    """
    if QUOTE in delimiter:
        raise ValueError("a delimiter that holds a quote cannot be quoted")
    escape, sign, other = [c for c in map(chr, (*range(1, 32), *range(0xE000, 0xF900))) if c not in delimiter][:3]
    mark, own = escape + sign, escape + other
    escaped = F.replace(value, F.lit(escape), F.lit(own))
    outside = F.transform(F.split(escaped, QUOTE, -1), lambda s, i: F.when(i % 2 == 0, F.replace(s, F.lit(delimiter), F.lit(mark))).otherwise(s))
    parts = F.transform(F.split(F.array_join(outside, QUOTE), pattern(mark), -1), lambda p: F.replace(p, F.lit(own), F.lit(escape)))
    # Values without a quote need no toggling.
    return F.when(value.isNull(), F.lit(None)).when(~F.contains(value, F.lit(QUOTE)), split_plain(value, delimiter)).otherwise(parts)


def split(value: Column, delimiter: str, quotes: bool = False) -> Column:
    return split_quoted(value, delimiter) if quotes else split_plain(value, delimiter)


def unquote(cell: Column) -> Column:
    """Without the quotes around it, doubled quotes halved; only where it starts and ends with one."""
    wrapped = (F.length(cell) >= 2) & F.startswith(cell, F.lit(QUOTE)) & F.endswith(cell, F.lit(QUOTE))
    return F.when(wrapped, F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)


def split_columns(row: Column, delimiter: str, quotes: bool = False) -> Column:
    parts = split(row, delimiter, quotes)
    return F.transform(parts, unquote) if quotes else parts


def trim_return(value: Column) -> Column:
    """Without one carriage return at the end."""
    return F.when(F.endswith(value, F.lit("\r")), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)


def trim_returns(parts: Column) -> Column:
    """The same for every part that a delimiter ended: all but the last."""
    return let(parts, lambda ps: F.transform(ps, lambda v, i: F.when(i < F.size(ps) - 1, trim_return(v)).otherwise(v)))


def strip_bom(value: Column) -> Column:
    return F.when(F.startswith(value, F.lit("﻿")), F.substring(value, F.lit(2), F.length(value))).otherwise(value)


def visible_characters(value: Column) -> Column:
    """Control characters and separators as symbols."""
    return F.translate(value, "".join(VISIBLE), "".join(VISIBLE.values()))


def search(value: Column, needle: str, start: int = 0, end: int | None = None) -> Column:
    """Offset of the first match that lies in [start, end), or -1. Offsets count characters."""
    inside = value if end is None else F.substring(value, F.lit(1), F.lit(max(end, 0)))
    return (F.locate(needle, inside, start + 1) - 1).cast("long")


#: Lengths that are summed into one of the next level, and levels: enough for every delimiter of a value of 2 GB.
_GROUP, _LEVELS = 16, 8


def running_sums(lengths: Column) -> Column:
    """For each of ``lengths`` the sum of those before it.

    Sums of groups, of groups of groups and so on stand in arrays of their own, so each answer adds a few
    numbers of every level, however many there are.
    """

    def group_sums(level: Column) -> Column:
        groups = F.floor((F.size(level) - 1) / _GROUP).cast("int")
        each = F.transform(F.sequence(F.lit(0), F.greatest(groups, F.lit(0))), lambda j: F.aggregate(F.slice(level, j * _GROUP + 1, F.lit(_GROUP)), F.lit(0).cast("long"), lambda n, x: n + x))
        return F.when(F.size(level) > 0, each).otherwise(F.array().cast("array<bigint>"))

    def before(level: Column, k: int) -> Column:
        """The running sums of a level, from those of the level above."""

        def within(above: Column | None) -> Column:
            def one(_: Column, i: Column) -> Column:
                own = F.aggregate(F.slice(level, i - i % _GROUP + 1, i % _GROUP), F.lit(0).cast("long"), lambda n, x: n + x)
                return own if above is None else own + F.get(above, F.floor(i / _GROUP).cast("int"))

            return F.transform(level, one)

        return within(None) if k == _LEVELS else let(let(group_sums(level), lambda up: before(up, k + 1)), within)

    return let(F.transform(lengths, lambda x: x.cast("long")), lambda level: before(level, 1))


def _ends(parts: Column, length, gap: int) -> Column:
    """Where each of ``parts`` ends, in units of ``length``, when ``gap`` units stand between them."""

    def ends(ps: Column) -> Column:
        return let(running_sums(F.transform(ps, lambda p: length(p) + gap)), lambda sums: F.transform(ps, lambda p, i: F.get(sums, i) + length(p)))

    return let(parts, ends)


def _ranges(ends: Column, gap: int) -> Column:
    def ranges(es: Column) -> Column:
        return F.transform(es, lambda e, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(es, i - 1) + gap).cast("long").alias("start"), e.cast("long").alias("end")))

    return let(ends, ranges)


def byte_ranges(value: Column, delimiter: str) -> Column:
    """Every range between delimiters as (start, end) in bytes of the UTF-8 text."""
    gap = len(delimiter.encode())
    return _ranges(_ends(split_plain(value, delimiter), F.octet_length, gap), gap)


def search_matches(value: Column, delimiter: str, quote: str = QUOTE) -> Column:
    """Every match of either pattern as (offset, pattern_id), ordered; 0 is the delimiter and wins ties.

    Matches of one pattern do not overlap; offsets count characters.
    """

    def offsets(needle: str, pattern_id: int) -> Column:
        matches = let(_ends(split_plain(value, needle), F.length, len(needle)), lambda es: F.slice(es, F.lit(1), F.size(es) - 1))
        return F.transform(matches, lambda e: F.struct(e.cast("long").alias("offset"), F.lit(pattern_id).alias("pattern_id")))

    return F.array_sort(F.concat(offsets(delimiter, 0), offsets(quote, 1)))


def search_all(value: Column, delimiter: str, limit: int | None = None) -> Column:
    """Every range between matches as (start, end) in characters, empty ones and the trailing one included.

    ``limit`` keeps the first ranges only.
    """
    ranges = _ranges(_ends(split_plain(value, delimiter), F.length, len(delimiter)), len(delimiter))
    return ranges if limit is None else F.slice(ranges, F.lit(1), F.lit(limit))
