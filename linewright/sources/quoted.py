"""Quoted records of files: what a task can tell of a split, and how it puts lines together.

A split's lines are read one after another by one task, so no window and no shuffle is needed inside
of it. What a split cannot know is whether it begins inside quotes. So :func:`surveyed` takes stock for
both cases; with the parities added up, :func:`assembled` joins the lines of each row. Only rows that
cross the border of a split leave in fragments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

QUOTE = 34
SURVEY = "_file string, _block long, _size long, _lines long, _bytes long, _quotes long, _rows array<long>, _width array<int>, _head binary, _last binary, _first long"
ROWS = "_file string, _pos long, _block long, _part int, _odd int, raw binary"


def _splits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batches, cut where a task goes on to its next split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("_file").dictionary_encode(), batch.column("_block").to_numpy()
        codes = files.indices.to_numpy()
        edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            yield (files.dictionary[int(codes[a])].as_py(), int(blocks[a])), batch.slice(a, b - a)


def _bytes_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the lines one after another, and where each line begins (one more: the end)."""
    wide = lines.type in (pa.large_binary(), pa.large_string())
    _, offsets, data = lines.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def _running(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place, the end included."""
    return np.concatenate(([0], np.cumsum(marks)))


class _Survey:
    """What one split holds: counts, and for a begin outside (0) and inside (1) of quotes its rows and their width."""

    def __init__(self, size: int, crlf: bool, skip_empty: bool, comma: int | None):
        self.size = size
        self.crlf, self.skip_empty, self.comma = crlf, skip_empty, comma
        self.lines = self.bytes = self.quotes = 0
        self.rows, self.width, self.open_cells = [0, 0], [0, 0], [0, 0]
        self.open_row = [False, False]
        self.head: list[bytes] | None = []
        self.head_done, self.last = False, b""

    def add(self, lines: pa.Array) -> None:
        raw, bounds = _bytes_of(lines)
        is_quote = raw == QUOTE
        before = _running(is_quote)
        start, size = (self.quotes + before[bounds[:-1]]) & 1, np.diff(bounds)
        filled = size > 0
        if self.crlf:
            alone = np.flatnonzero(size == 1)
            filled[alone] = raw[bounds[alone]] != 13
        commas = None
        if self.comma is not None:
            odd = (self.quotes + before[:-1]) & 1
            is_comma = raw == self.comma
            commas = [_running(is_comma & (odd == k)) for k in (0, 1)]
        for k in (0, 1):
            begins = start == k
            self.rows[k] += int((begins & filled).sum() if self.skip_empty else begins.sum())
            if commas is not None:
                self._cells(k, np.flatnonzero(begins), filled, np.diff(commas[k][bounds]))
        if not self.head_done:
            self._find_head(lines, start, filled)
        self.last = lines[-1].as_py()
        self.lines += len(lines)
        self.bytes += len(raw)
        self.quotes += int(before[-1])

    def _cells(self, k: int, begins: np.ndarray, filled: np.ndarray, held: np.ndarray) -> None:
        """The widest row among those that begin here; the last one goes on into the next batch."""
        total = _running(held)
        self.open_cells[k] += int(total[begins[0]] if len(begins) else total[-1])
        if not len(begins):
            return
        self._close(k)
        ends = np.append(begins[1:], len(held))
        cells = total[ends] - total[begins]
        if len(begins) > 1:
            own = cells[:-1][filled[begins[:-1]]] if self.skip_empty else cells[:-1]
            self.width[k] = max(self.width[k], int(own.max(initial=-1)) + 1)
        self.open_cells[k] = int(cells[-1])
        self.open_row[k] = bool(filled[begins[-1]]) or not self.skip_empty

    def _close(self, k: int) -> None:
        if self.open_row[k]:
            self.width[k] = max(self.width[k], self.open_cells[k] + 1)
        self.open_row[k] = False

    def _find_head(self, lines: pa.Array, start: np.ndarray, filled: np.ndarray) -> None:
        """The split's first row, if it begins outside of quotes."""
        begins = np.flatnonzero(start == 0)
        if self.head:  # open since the batch before
            end = int(begins[0]) if len(begins) else len(lines)
            self.head += lines.slice(0, end).to_pylist()
            self.head_done = len(begins) > 0
            return
        found = begins[filled[begins]] if self.skip_empty else begins
        if len(found):
            after = begins[begins > found[0]]
            end = int(after[0]) if len(after) else len(lines)
            self.head = lines.slice(int(found[0]), end - int(found[0])).to_pylist()
            self.head_done = len(after) > 0

    def row(self, key: tuple[str, int], delimiter: bytes) -> list:
        for k in (0, 1):
            if (k + self.quotes) % 2 == 0:  # closed at the end of the split
                self._close(k)
        # A head that the split's end cuts is the whole row only if its quotes are closed there.
        whole = self.head and (self.head_done or sum(x.count(b'"') for x in self.head) % 2 == 0)
        return [*key, self.size, self.lines, self.bytes, self.quotes, self.rows, self.width, delimiter.join(self.head) if whole else None, self.last, 0]


def surveyed(delimiter: bytes, crlf: bool, skip_empty: bool, comma: int | None) -> Callable:
    """For mapInArrow over (_file, _block, _size, raw): a row of SURVEY for each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, survey, done = None, None, []
        for own, batch in _splits_of(batches):
            if own != key:
                if survey:
                    done.append(survey.row(key, delimiter))
                key, survey = own, _Survey(batch.column("_size")[0].as_py(), crlf, skip_empty, comma)
            survey.add(batch.column("raw"))
        if survey:
            done.append(survey.row(key, delimiter))
        kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
        names = [f.split()[0] for f in SURVEY.split(", ")]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    return run


class _Rows:
    """Joins the lines of one split. ``pos`` is the number of the next row that begins.

    The row ``end`` is marked with 1, or with 2 if it holds the delimiter behind it.
    """

    def __init__(self, key: tuple[str, int], inside: bool, pos: int, end: int, hold: bool, delimiter: bytes, crlf: bool, skip_empty: bool):
        self.key, self.quotes, self.pos, self.last, self.mark = key, int(inside), pos, end, 2 if hold else 1
        self.delimiter, self.crlf, self.skip_empty = delimiter, crlf, skip_empty
        self.held: list[pa.Array] = []  # lines of the row that is open, or of the one that the split begins in
        self.crossing = bool(inside)

    def _batch(self, values: pa.Array, first: int, fragment: int) -> pa.RecordBatch:
        n, pos = len(values), np.arange(first, first + len(values))
        return pa.RecordBatch.from_arrays([pa.array([self.key[0]] * n, pa.string()), pa.array(pos), pa.array([self.key[1]] * n, pa.int64()), pa.array([fragment] * n, pa.int32()), pa.array((pos == self.last) * self.mark, pa.int32()), values], names=[f.split()[0] for f in ROWS.split(", ")])

    def _whole(self, values: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.skip_empty:
            keep = pc.greater(pc.binary_length(values), 0)
            values = values.filter(pc.and_(keep, pc.not_equal(values, pa.scalar(b"\r", values.type))) if self.crlf else keep)
        if len(values):
            yield self._batch(values, self.pos, 0)
            self.pos += len(values)

    def _flush(self) -> Iterator[pa.RecordBatch]:
        """The lines held: a row of this split, or the end of one that began before it."""
        if not self.held:
            return
        lines, self.held = pa.concat_arrays(self.held), []
        value = pa.array([self.delimiter.join(lines.to_pylist())], pa.binary())
        if self.crossing:
            yield self._batch(value, self.pos - 1, 1)
            self.crossing = False
        else:
            yield from self._whole(value)

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        raw, bounds = _bytes_of(lines)
        before = _running(raw == QUOTE)
        begins = np.flatnonzero((self.quotes + before[bounds[:-1]]) % 2 == 0)
        self.quotes += int(before[-1])
        if not len(begins):
            self.held.append(lines)
            return
        if begins[0]:
            self.held.append(lines.slice(0, int(begins[0])))
        yield from self._flush()
        self.crossing = False
        if len(begins) > 1:
            rest = lines.slice(int(begins[0]), int(begins[-1] - begins[0]))
            lists = pa.ListArray.from_arrays(pa.array(begins - begins[0], pa.int32()), rest)
            yield from self._whole(pc.binary_join(lists, pa.scalar(self.delimiter, pa.binary())))
        self.held.append(lines.slice(int(begins[-1])))

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held and self.quotes % 2 and not self.crossing:  # goes on in the next split
            yield self._batch(pa.array([self.delimiter.join(pa.concat_arrays(self.held).to_pylist())], pa.binary()), self.pos, 1)
        else:
            yield from self._flush()


def assembled(delimiter: bytes, crlf: bool, skip_empty: bool) -> Callable:
    """For mapInArrow over (_file, _block, _inside, _base, _end, _hold, raw): rows of ROWS, whole ones with _part 0, fragments with 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, None
        for own, batch in _splits_of(batches):
            if own != key:
                if rows:
                    yield from rows.end()
                key, rows = own, _Rows(own, *(batch.column(c)[0].as_py() for c in ("_inside", "_base", "_end", "_hold")), delimiter, crlf, skip_empty)
            yield from rows.add(batch.column("raw"))
        if rows:
            yield from rows.end()

    return run
