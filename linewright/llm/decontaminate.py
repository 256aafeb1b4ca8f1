"""Benchmark decontamination with one Aho-Corasick automaton.

A window is ``width`` consecutive words of a benchmark text. The automaton holds a part of each
text only: blocks of ``width // 2`` words, as many words apart as make every window hold a block
whole. A document is normalised the same way (words with single spaces around them) and scanned once.
Where a block occurs, the words on its sides are compared with those of the benchmark texts that hold
it, as far as a window reaches; so exactly the windows are found, with an automaton about a tenth of
the size that all windows would make. Matches are mapped back: first to word numbers, then to code
points of the original text.

A benchmark of more than ``pattern_bytes`` is dealt over several automata by item id. Each then scans
a table that the one before wrote, so a worker never holds two.

Defined results: a null or wordless document has no words and no hits; an item without words or
without an id gives no window; an item of fewer than ``width`` words is one window; repeated items
and windows count once for each distinct item id; an empty benchmark hits nothing; a text of any
length is scanned whole; repeated rows each get their answer; there are no ties, as every hit
counts; an empty table gives no row. Input columns named like an output column give way to it.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import WORDS, add_columns, distinct, field, raw_texts, take_turn
from linewright.session import materialise

#: Bytes of benchmark texts that one automaton (and one broadcast) may hold: a worker then needs 360 MB for it.
PATTERN_BYTES = 8 << 20
#: Pairs of a block in a document and its place in the benchmark that are compared at once.
COMPARED = 1 << 18
_BUILT: dict[str, Index | None] = {}


class Index:
    """The automaton over ``items`` (id, text), and the benchmark's words as numbers, text after text."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.width, self.block = width, max(1, width // 2)
        step, self.reach = width - self.block + 1, width - self.block
        self.number: dict[bytes, int] = {}
        ids_of: dict[tuple, set] = {}
        for item, text in items:
            words = tuple(self.number.setdefault(w, len(self.number)) for w in text.translate(WORDS).split())
            if words:
                ids_of.setdefault(words, set()).add(item)
        word = [w.decode("latin-1") for w in self.number]
        # Texts stand apart by numbers that no word has, so a comparison ends with its text.
        apart, parts, at = np.full(width, -1, np.int32), [], 0
        self.first, self.ids = [], []
        places: dict[str, list[int]] = {}
        self.short: dict[str, tuple[int, tuple[str, ...]]] = {}
        for words, ids in ids_of.items():
            parts += [apart, np.array(words, np.int32)]
            at += width
            self.first.append(at)
            self.ids.append(tuple(ids))
            if len(words) < width:
                self.short[self._key(word[w] for w in words)] = (len(words), tuple(ids))
            for k in range(0, len(words) - width + step, step) if len(words) >= width else ():
                places.setdefault(self._key(word[w] for w in words[k : k + self.block]), []).append(at + k)
            at += len(words)
        self.flat = np.concatenate([*parts, apart])
        self.first = np.array(self.first, np.int64)
        self.automaton = ahocorasick.Automaton()
        for key in {*places, *self.short}:
            self.automaton.add_word(key, (np.array(places.get(key, ()), np.int64), self.short.get(key)))
        self.automaton.make_automaton()

    @staticmethod
    def _key(words) -> str:
        return " " + " ".join(words) + " "

    def scan(self, raw: bytes) -> tuple[int, np.ndarray, set]:
        """(number of words, mask of the hit words or an empty one, ids of the items found)."""
        words = raw.translate(WORDS).split()
        none = np.zeros(0, bool)
        if not words:
            return 0, none, set()
        line = b" " + b" ".join(words) + b" "
        ends, found = [], []
        for end, value in self.automaton.iter(line.decode("latin-1")):
            ends.append(end)
            found.append(value)
        if not ends:
            return len(words), none, set()
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        behind = np.searchsorted(spaces, ends)  # the space behind word k-1 is the k-th
        change, items = np.zeros(len(words) + 1, np.int64), set()
        for stop, (_, short) in zip(behind.tolist(), found, strict=True):
            if short:
                change[stop - short[0]] += 1
                change[stop] -= 1
                items.update(short[1])
        sizes = np.array([len(places) for places, _ in found])
        starts = behind[sizes > 0] - self.block
        if len(starts):
            number = self.number
            own = np.full(len(words) + 2 * self.reach, -2, np.int32)
            own[self.reach : self.reach + len(words)] = [number.get(w, -2) for w in words]
            held = [places for places, _ in found if len(places)]
            for at, end in _runs_of(sizes[sizes > 0], COMPARED):
                n = [len(x) for x in held[at:end]]
                self._extend(own, np.repeat(starts[at:end], n), np.concatenate(held[at:end]), change, items)
        hit = np.cumsum(change[:-1]) > 0
        return len(words), hit if hit.any() else none, items

    def _extend(self, own: np.ndarray, start: np.ndarray, place: np.ndarray, change: np.ndarray, items: set) -> None:
        """Adds the windows around the blocks that stand at ``start`` in the document and ``place`` in the benchmark."""
        shifted, left, right = start + self.reach, np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for side, first, step in ((left, -1, -1), (right, self.block, 1)):
            same = np.ones(len(start), bool)
            for k in range(self.reach):
                same &= own[shifted + first + step * k] == self.flat[place + first + step * k]
                side += same
        whole = np.flatnonzero(left + self.block + right >= self.width)
        np.add.at(change, start[whole] - left[whole], 1)
        np.add.at(change, start[whole] + self.block + right[whole], -1)
        for text in distinct(np.searchsorted(self.first, place[whole], "right") - 1).tolist():
            items.update(self.ids[text])


def _runs_of(sizes: np.ndarray, most: int):
    """Ranges of entries whose sizes add up to about ``most``."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in code points of the original text."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([0], (np.frombuffer(raw.translate(WORDS), np.uint8) != 32).view(np.int8), [0]))
    edge = np.diff(inside)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points[np.flatnonzero(edge == 1)], points[np.flatnonzero(edge == -1)]


def runs(hit: np.ndarray, raw: bytes) -> list[tuple[int, int]]:
    """The hit words as maximal runs, in code points of the original text."""
    if not hit.any():
        return []
    starts, ends = word_spans(raw)
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return list(zip(starts[np.flatnonzero(edge == 1)].tolist(), ends[np.flatnonzero(edge == -1) - 1].tolist(), strict=True))


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the code points of ``spans``."""
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]]) if spans else text


def _pass(df: DataFrame, items: list[tuple[str, bytes]], width: int, text: str, first: bool, keep: list[str], excise: bool = False) -> DataFrame:
    """One scan with one automaton; joins what it finds to what earlier passes found."""
    shared, key = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def fn(batches):
        take_turn("decontaminate", _BUILT.clear)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Index(shared.value, width) if shared.value else None
        index = _BUILT[key]
        for batch in batches:
            n_words, n_hit, ids, spans, masks, left = [], [], [], [], [], []
            before = None if first else (batch.column("item_ids").to_pylist(), batch.column("_hit").to_pylist())
            for k, raw in enumerate(raw_texts(batch, text)):
                n, hit, found = index.scan(raw or b"") if index else (len((raw or b"").translate(WORDS).split()), np.zeros(0, bool), set())
                if before and before[1][k]:
                    old = np.unpackbits(np.frombuffer(before[1][k], np.uint8), count=n).astype(bool)
                    hit = old | hit if len(hit) else old
                    found = found | set(before[0][k])
                n_words.append(n)
                n_hit.append(int(hit.sum()))
                ids.append(sorted(found))
                held = runs(hit, raw or b"")
                spans.append([{"start": a, "end": b} for a, b in held])
                if excise:
                    left.append(cut(None if raw is None else raw.decode(), held))
                masks.append(np.packbits(hit).tobytes() if hit.any() else None)
            yield batch, [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(masks, pa.binary())] + ([pa.array(left, pa.string())] if excise else [])

    return add_columns(df, fn, [field("n_words", "long"), field("n_hit", "long"), field("item_ids", "array<string>"), field("hit_spans", "array<struct<start:int,end:int>>"), field("_hit", "binary")] + ([field(text, "string")] if excise else []), keep)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 8, min_items: int = 2, pattern_bytes: int = PATTERN_BYTES, columns: list[str] | None = None, excise: bool = False) -> DataFrame:
    """``docs`` (or its ``columns``) with n_words, n_hit, item_ids, hit_spans and contaminated.

    With ``excise`` the text comes back without the hit spans.

    No shuffle: documents are scanned where they are read. The benchmark's size is taken first;
    a part of it, ``pattern_bytes`` at most on average, is on the driver at a time.
    """
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.col(item_text).cast("string").alias("text")).where("id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    shards = int(total // pattern_bytes) + 1
    keep = list(dict.fromkeys([*(columns if columns is not None else docs.columns), text]))
    out = docs.select(*keep)
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(shards)) == k)
        held = [(r["id"], r["text"].encode()) for r in part.toLocalIterator()]
        out = _pass(out, held, width, text, k == 0, keep, excise and k == shards - 1)
        if k < shards - 1:
            out = materialise(out, "decontamination")
    out = out.drop("_hit").withColumn("contaminated", F.size("item_ids") >= min_items)
    return out if columns is None or text in columns else out.drop(text)
