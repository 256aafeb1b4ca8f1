"""Token ids in files of independent zstandard frames with a trailing seek table.

File layout, little-endian: frames one after another, one for each document, each the zstandard
compression (with content size and checksum) of the document's ids as unsigned 32-bit integers;
then one more zstandard frame with the table, a row for each document:
``doc_id int64, offset uint64, length uint32, n_tokens uint32, crc32 uint32 (the checksum of the
stored frame), has_id uint8``; then the footer ``table_offset uint64, table_length uint32, n_docs
uint32, table_crc32 uint32, magic "LWTOKEN2"``. A reader fetches the footer, the table and then only
the frames it wants. Ids below 65536 in every token of a document are stored as 16-bit integers; the
width follows from the frame's content size over n_tokens.

Documents are dealt into ranges of ids, as many as their bytes ask for; an id that repeats over
several ranges is parted by the checksum of its frames. A range becomes one file or more: a file
ends at ``FILE_BYTES`` or ``FILE_DOCS``, which also bounds the table that a task holds.

Defined results: a null or empty text holds only the end id; repeated ids are written as often as
they come, in the order of their frames' checksums; rows with a null id stand behind all others (in
the table with has_id 0); a text of any length is one document and one frame; an empty table gives
no file and no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from linewright.llm.common import LOWER, distinct, take_turn
from linewright.session import scratch_path, ship_package

ROW = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_tokens", "<u4"), ("crc32", "<u4"), ("has_id", "u1")])
_ROW = struct.Struct("<qQIIIB")
FOOTER, MAGIC = struct.Struct("<QIII8s"), b"LWTOKEN2"
#: A file ends behind the frame that reaches either; bytes of texts that a range of ids should hold.
FILE_BYTES, FILE_DOCS, RANGE_BYTES = 256 << 20, 1 << 20, 512 << 20
#: Distinct chunks of texts whose ids a Python worker remembers.
REMEMBERED = 700_000
#: Bytes of texts that are encoded at once.
GATHERED = 12 << 20
_UNPACKER = zstandard.ZstdDecompressor()
SPACED = LOWER.translate(bytes.maketrans(b"\n\t", b"  "))
#: Words that the library gets at once, white space between them.
JOINED = 64
#: Kinds of bytes of lower-cased texts. Other ones, control characters among them, are never parted from their neighbours.
SPACE, LETTER, DIGIT, SIGN, APOSTROPHE, OTHER = range(6)
KIND = np.array([SPACE if c == 32 else LETTER if 97 <= c <= 122 else DIGIT if 48 <= c <= 57 else APOSTROPHE if c == 39 else SIGN if 32 < c < 127 else OTHER for c in range(256)], np.uint8)
#: By 8 times the kind of a byte and that of the next: whether a chunk begins between them. A letter goes on with letters,
#: a sign with signs, a digit with nothing; an apostrophe may also begin a match with letters behind it.
PARTED = np.zeros(64, bool)
PARTED[[SPACE * 8 + k for k in (LETTER, DIGIT, SIGN, APOSTROPHE, OTHER)]] = True
PARTED[[LETTER * 8 + k for k in (DIGIT, SIGN, APOSTROPHE)] + [DIGIT * 8 + k for k in (LETTER, DIGIT, SIGN, APOSTROPHE)]] = True
PARTED[[SIGN * 8 + k for k in (LETTER, DIGIT)] + [APOSTROPHE * 8 + DIGIT]] = True
_ENCODERS: dict[str, ChunkEncoder] = {}


def separable(config: dict) -> bool:
    """Whether a tokenizer's file says that chunks between white space can be encoded on their own: it composes,
    folds white space and lower-cases, then drops what is no match of its pattern. No match spans white space,
    and marks are never in one with letters. Anything else is encoded in whole texts."""
    # The steps this is true for, as they stand in the file.
    normalizer = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    added = all(t["content"].startswith("<|") for t in config.get("added_tokens") or [])
    parted = steps[0].get("type") == "Split" and steps[0].get("pattern") == {"Regex": pattern} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return config.get("normalizer") == normalizer and added and parted and byte_level and not config.get("post_processor") and not config.get("truncation") and not config.get("padding")


class ChunkEncoder:
    """The tokenizer's ids of whole texts, put together from those of chunks that no match of its pattern spans.

    Exact for tokenizers that are :func:`separable`; ``whole`` keeps texts in one piece, and so does
    None, the default, for any other tokenizer.
    """

    def __init__(self, path: str, whole: bool | None = None):
        # A task has one core; the library's own threads would only wait for one another.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.whole = whole if whole is not None else not separable(config)
        self.tokenizer = Tokenizer.from_file(path)
        # The chunks that are remembered, and the bytes of their ids.
        self.known, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())
        suffix, vocabulary = config["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix and all(c + suffix in vocabulary for c in ByteLevel.alphabet()):
            # Then the last token of every match of the pattern ends with it, and no other token does.
            self.last[[k for t, k in vocabulary.items() if t.endswith(suffix)]] = True

    def __call__(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, ``end_id`` behind each, and where each text's begin (one more: the end)."""
        if self.whole:
            own = [[*e.ids, end_id] for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.array(list(chain.from_iterable(own)), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)
        chunks, bounds = chunked(texts)
        which = pc.index_in(chunks, value_set=self.known)
        missing = chunks.filter(which.is_null())
        fresh, ids, n_kept = self._fresh_ids(missing.unique().to_pylist())
        which = which.fill_null(-1).to_numpy().copy()
        which[which < 0] = len(self.known) + pc.index_in(missing, value_set=fresh).to_numpy()
        every = pa.concat_arrays([self.ids, ids, pa.array([np.uint32(end_id).tobytes()], pa.large_binary())])
        # The end id of a text stands behind its chunks.
        ends = bounds[1:] + np.arange(len(texts))
        order = np.full(len(which) + len(texts), len(every) - 1, np.int32)
        inner = np.ones(len(order), bool)
        inner[ends] = False
        order[inner] = which
        taken = every.take(pa.array(order))
        _, offsets, data = taken.buffers()
        starts = np.concatenate(([0], np.frombuffer(offsets, np.int64)[ends + 1] // 4))
        self.known, self.ids = pa.concat_arrays([self.known, fresh[:n_kept]]), every[: len(self.known) + n_kept]
        if len(self.known) > REMEMBERED:
            used = distinct(which)
            used = pa.array(used[used < len(self.known)][:REMEMBERED])
            self.known, self.ids = self.known.take(used), self.ids.take(used)
        return np.frombuffer(data, np.uint32, starts[-1]), starts

    def _fresh_ids(self, chunks: list[str]) -> tuple[pa.Array, pa.Array, int]:
        """The chunks in another order, the bytes of their ids, and how many of them, from the first, are short enough to remember."""
        words, others = [x for x in chunks if x.isalpha() and len(x) < 100], [x for x in chunks if not x.isalpha() and len(x) < 100]
        lines = [words[k : k + JOINED] for k in range(0, len(words), JOINED)]
        done, found = [], []
        for line, e in zip(lines, self.tokenizer.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.last[ids]) + 1
            # No word is without a match: as many last tokens as words are one for each. Others are encoded alone.
            if len(stops) == len(line):
                done += line
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                found += [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            else:
                others += line
        n_kept = len(done) + len(others)
        others += [x for x in chunks if len(x) >= 100]
        found += [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        return pa.array(done + others, pa.string()), pa.array(found, pa.large_binary()), n_kept


def chunked(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The chunks of all texts one after another, and how many there are before each text (one more: all).

    Lower-cased as the tokenizer would, as far as ASCII and Latin-1 go. Parted at characters that every tokenizer takes
    for white space, and between two known characters that :data:`PARTED` tells apart. A text that may hold a special
    token is one chunk, as it is, and so is one with a mark that a letter might be composed with before it is lower-cased.
    """
    special = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, "[\u0300-\u036f]"))
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data = np.frombuffer(bytearray(raw.tobytes().translate(SPACED)), np.uint8)
    kind = KIND[data]
    # Letters of Latin-1 but the signs of multiplication and division: C3 80 to C3 BF.
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] & 0xDF) != 0x97]
    kind[lead] = kind[lead + 1] = LETTER
    upper = lead[data[lead + 1] < 0x9F] + 1
    data[upper] += 0x20
    begins = np.zeros(len(data) + 1, bool)
    begins[1:-1] = PARTED[kind[:-1] * np.uint8(8) + kind[1:]]
    begins[offsets[:-1]] = True
    begins[-1] = True
    spaces = kind == SPACE
    begins[:-1] &= ~spaces
    for k in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
        a, b = offsets[k], offsets[k + 1]
        data[a:b], begins[a:b], spaces[a:b] = raw[a:b], False, False
        begins[a] = True
    firsts = np.flatnonzero(begins[:-1])
    # A chunk goes up to the next one or white space.
    ends = np.flatnonzero(~spaces & (begins[1:] | np.append(spaces[1:], True))) + 1
    bounds = np.searchsorted(firsts, offsets)
    at = np.concatenate(([0], np.cumsum(ends - firsts))).astype(np.int32)
    return pa.StringArray.from_buffers(len(firsts), pa.py_buffer(at), pa.py_buffer(data[~spaces])), bounds


def encoder(path: str, whole: bool | None) -> ChunkEncoder:
    take_turn("tokenfile", _ENCODERS.clear)
    key = f"{path}|{whole}"
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(path, whole)
    return _ENCODERS[key]


def frame(ids: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    return packer.compress((ids.astype("<u2") if ids.max(initial=0) < 65536 else ids.astype("<u4")).tobytes())


def unframe(raw: bytes, n: int) -> np.ndarray:
    data = _UNPACKER.decompress(raw)
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class Writer:
    """Writes one file; the file appears under its name only when it is complete."""

    def __init__(self, path: str, attempt: int):
        self.fs, self.path = open_fs(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{attempt}.part"
        self.out, self.at, self.table, self.n_ids = self.fs.open_output_stream(self.part), 0, bytearray(), 0

    def add(self, doc_id: int | None, n_tokens: int, raw: bytes) -> None:
        self.out.write(raw)
        self.table += _ROW.pack(doc_id or 0, self.at, len(raw), n_tokens, zlib.crc32(raw), doc_id is not None)
        self.at += len(raw)
        self.n_ids += n_tokens

    def holds(self, n_bytes: int, n_docs: int) -> bool:
        """Whether it has as much as either."""
        return self.at >= n_bytes or len(self.table) >= n_docs * _ROW.size

    def close(self) -> tuple[int, int]:
        raw, n = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(bytes(self.table)), len(self.table) // _ROW.size
        self.out.write(raw)
        self.out.write(FOOTER.pack(self.at, len(raw), n, zlib.crc32(raw), MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)
        return n, self.n_ids


class Reader:
    """Random access to one file: the table at once, frames on demand."""

    def __init__(self, path: str):
        self.fs, self.path = open_fs(path)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        offset, length, n, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        raw = self.file.read_at(length, offset)
        if magic != MAGIC or zlib.crc32(raw) != crc:
            raise ValueError(f"{path}: damaged table")
        self.table = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), ROW)
        if len(self.table) != n:
            raise ValueError(f"{path}: damaged table")

    def _ids(self, row, raw: bytes) -> np.ndarray:
        if zlib.crc32(raw) != row["crc32"]:
            raise ValueError(f"{self.path}: damaged frame of document {row['doc_id']}")
        return unframe(raw, int(row["n_tokens"]))

    def ids(self, doc_id: int) -> np.ndarray:
        """The ids of one document; reads its frame only."""
        named = self.table["doc_id"][: int(self.table["has_id"].sum())]
        k = int(np.searchsorted(named, doc_id))
        if k == len(named) or named[k] != doc_id:
            raise KeyError(doc_id)
        row = self.table[k]
        return self._ids(row, self.file.read_at(int(row["length"]), int(row["offset"])))

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, from reads of a few MB."""
        at, table = 0, self.table
        while at < len(table):
            end = max(at + 1, int(np.searchsorted(table["offset"], table["offset"][at] + (4 << 20))))
            first = int(table["offset"][at])
            raw = self.file.read_at(int(table["offset"][end - 1] + table["length"][end - 1]) - first, first)
            for row in table[at:end]:
                a = int(row["offset"]) - first
                yield int(row["doc_id"]) if row["has_id"] else None, self._ids(row, raw[a : a + int(row["length"])])
            at = end


def gathered(batches: Iterable[pa.RecordBatch], size: int = GATHERED) -> Iterator[pa.Table]:
    """Batches put together up to ``size`` bytes: the more texts at once, the fewer chunks to look up."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def range_of(ids: pa.Array, marks: np.ndarray, cuts: np.ndarray, unnamed: int) -> np.ndarray:
    """The range of every id: how many ``cuts`` are below it. One that several cuts name is parted by its
    ``marks`` (of 32 bits); null ids go to ``unnamed`` ranges behind the others, by the same."""
    known = pc.fill_null(ids, 0).to_numpy()
    low, high = np.searchsorted(cuts, known, "left"), np.searchsorted(cuts, known, "right")
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    low, high = np.where(missing, len(cuts) + 1, low), np.where(missing, len(cuts) + 1 + unnamed, high)
    return low + (marks.astype(np.int64) * np.maximum(high - low, 1) >> 32)


def encode_frames(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, whole: bool | None = None, cuts: list[int] | None = None, unnamed: int = 1) -> DataFrame:
    """(doc_id, n_tokens, frame, mark, part) of every document; encoded where it is read.

    ``mark`` is the frame's checksum, ``part`` the range of :func:`range_of` between the sorted ``cuts``.
    """
    ship_package(docs.sparkSession)
    bounds = np.array(cuts or [], np.int64)

    def run(batches):
        encode, packer = encoder(tokenizer, whole), zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        for table in gathered(batches):
            for batch in table.to_batches():
                ids, starts = encode(pc.fill_null(batch.column(1).cast(pa.string()), ""), end_id)
                frames = [frame(ids[a:b], packer) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                marks = np.fromiter(map(zlib.crc32, frames), np.int64, len(frames))
                part = range_of(batch.column(0), marks, bounds, unnamed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(starts)), pa.array(frames, pa.binary()), pa.array(marks), pa.array(part, pa.int32())], names=["doc_id", "n_tokens", "frame", "mark", "part"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, frame binary, mark long, part int")


def write_token_files(docs: DataFrame, tokenizer: str, path: str | None = None, *, file_bytes: int = FILE_BYTES, file_docs: int = FILE_DOCS, range_bytes: int = RANGE_BYTES, **options) -> list[tuple[str, int, int]]:
    """Writes the ids of ``docs`` in ascending doc_id order; returns (file, its documents, its ids) in that order.

    Only compressed frames are shuffled, by ranges of doc_id; a task writes the files of its range.
    What comes back to the driver is a row for each file. A task that is run again writes its files anew.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    ids = docs.select(F.col(options.get("doc_id", "doc_id")).cast("long").alias("doc_id"), F.col(options.get("text", "text")).cast("string").alias("text"))
    n_bytes, n_docs, n_named = ids.agg(F.sum(F.octet_length("text")), F.count("*"), F.count("doc_id")).first()
    if not n_docs:
        return []
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (n_bytes or 0) // range_bytes + 1)
    # Bounds from the id column alone: the texts are not read for them.
    cuts = sorted(ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], max(1000, 10 * n)).alias("q")).first()["q"] or [])
    unnamed = -(-(n_docs - n_named) * n // n_docs)

    def write(batches: Iterable[pa.RecordBatch]):
        context, out, name, at = TaskContext.get(), None, "", (-1, 0)
        done = lambda: pa.RecordBatch.from_pylist([dict(zip(("file", "n_docs", "n_ids"), (name, *out.close()), strict=True))])
        for batch in batches:
            for key, doc, n_tokens, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "frame")), strict=True):
                if out is None or key != at[0] or out.holds(file_bytes, file_docs):
                    if out is not None:
                        yield done()
                    at = (key, at[1] + 1 if key == at[0] else 0)
                    name = f"{path}/{key:08d}-{at[1]:05d}.lwt"
                    out = Writer(name, context.taskAttemptId())
                out.add(doc, n_tokens, raw)
        if out is not None:
            yield done()

    frames = encode_frames(docs, tokenizer, cuts=cuts, unnamed=unnamed, **options)
    parts = len(cuts) + 1 + unnamed
    done = frames.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "mark", "frame").mapInArrow(write, "file string, n_docs long, n_ids long").collect()
    return sorted((r["file"], r["n_docs"], r["n_ids"]) for r in done)


def read_token_files(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, crc32 of the ids as unsigned 32-bit integers) of every document in the files.

    ``start`` counts the ids of all documents before it, over all files.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    ship_package(spark)
    rows, start = [], 0
    for name, _, n in files:
        rows.append((name, start))
        start += n

    def read(batches):
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out = []
                for doc, ids in Reader(name):
                    out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(rows, "file string, start long").repartition(len(rows)).mapInArrow(read, schema)
