"""SentencePiece encoding and decoding over a trie of distinct words.

A text is marked (every space becomes the mark U+2581, one more stands in front) and cut into
marked words. The distinct words of a batch are sorted, which lays them out as the depth-first
traversal of their trie: a word keeps the forward states of the prefix it shares with the word
before and computes only the rest.

The forward state at a position is the last piece of the best segmentation of the prefix that ends
there. For ``kind="unigram"`` best means the highest sum of scores (Viterbi), and the state holds
the sum too; of equal sums the longest last piece wins, and a character without a piece costs 10
more than the worst piece. For a BPE vocabulary, such as the public one here, the
sums of scores do not give the pieces that merging gives; there the state is the piece that merging
the prefix ends with. It is the one piece that stands behind its predecessor's own state without the
two ever merging differently, so the same recurrence finds it, one position after the other.

Cutting is exact when no piece holds another character before a mark; this is checked, and texts
are one word where it does not hold. Characters without a piece become byte pieces, or where the
vocabulary has none one unknown piece for each run of them. Models must leave texts as they are
but for the mark in front; others are refused.

Decoding joins pieces and bytes, turns marks into spaces and drops one mark that starts the text;
control ids give nothing, unknown ones the library's sign, and each byte that is no UTF-8 U+FFFD.

Defined results: a null or empty text has no pieces; decoding gives the text back (marks in the
input come back as spaces); a text of any length is encoded whole; repeated rows each get their
answer; an empty table gives no row. Input columns named like an output column give way to it.
"""

from __future__ import annotations

import codecs
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from linewright.llm.common import add_columns, field, take_turn

MARK = "▁"
#: Distinct words, and pairs of pieces, that a Python worker remembers between batches.
REMEMBERED = 600_000
_LOADED: dict[tuple, "Vocabulary"] = {}
#: What an unknown id decodes to; what a character without a piece costs more than the worst piece.
UNKNOWN, PENALTY = " \u2047 ", 10.0

#: Bytes beyond ASCII, and control ids, which add nothing but part the bytes beside them.
_HIGH, _BREAK = re.compile("[\udc80-\udcff]"), "\ud800"
codecs.register_error("each-byte", lambda e: ("\ufffd", e.start + 1))


class Vocabulary:
    def __init__(self, path: str | None = None, kind: str = "bpe", pieces: dict[str, tuple[int, float]] | None = None):
        """From a model file, or from ``pieces``: piece -> (id, score). ``kind``: bpe or unigram."""
        self.kind, self.bytes, self.silent = kind, {}, frozenset()
        if path:
            spec = sentencepiece_model_pb2.ModelProto()
            with open(path, "rb") as f:
                spec.ParseFromString(f.read())
            rules = spec.normalizer_spec
            if rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
                raise ValueError(f"{path}: a model that normalises texts")
            model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
            n = model.get_piece_size()
            self.text_of = [model.id_to_piece(i) for i in range(n)]
            self.bytes = {int(self.text_of[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
            pieces = {self.text_of[i]: (i, model.get_score(i)) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
            self.unknown, self.silent = model.unk_id(), frozenset(i for i in range(n) if model.is_control(i))
        else:
            self.unknown = 0
            self.text_of = [""] * (max((i for i, _ in pieces.values()), default=0) + 1)
            for p, (i, _) in pieces.items():
                self.text_of[i] = p
        self.byte_of = {i: b for b, i in self.bytes.items()}
        # What each id adds to a text; bytes beyond ASCII stand as the surrogates that Python escapes them by.
        self.shown = [p.replace(MARK, " ") for p in self.text_of]
        for i, b in self.byte_of.items():
            self.shown[i] = chr(b if b < 0x80 else 0xDC00 + b)
        for i in self.silent:
            self.shown[i] = _BREAK
        self.shown[self.unknown] = UNKNOWN
        self.pieces, self.least = pieces, min((s for _, s in pieces.values()), default=0.0) - PENALTY
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        # Characters that no piece holds: nothing merges across them.
        alone = "".join(re.escape(c) for c in "\n\t\r" if not any(c in p for p in pieces))
        self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]+" if alone else ""))
        # A piece that merging its own characters does not give back never comes out of merging.
        # The rest stand in a trie of reversed pieces: from a position back, each step is one character.
        self.back: dict = {}
        for p in pieces:
            if kind != "bpe" or self.merge(p) == [p]:
                node = self.back
                for c in reversed(p):
                    node = node.setdefault(c, {})
                node[""] = p
        self.stands: dict[str, bool] = {}
        self.known: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The definition for a BPE vocabulary: merge the adjacent pair of the best score, leftmost first, till none is a piece."""
        parts = list(text)
        while True:
            best = max(((self.pieces[a + b][1], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.pieces), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _stands(self, a: str, b: str) -> bool:
        if len(self.stands) > REMEMBERED:
            self.stands.clear()
        ok = self.stands[a + "\n" + b] = self.merge(a + b) == [a, b]
        return ok

    def _ending(self, word: str, j: int) -> list[str]:
        """The pieces that word[:j] ends with, shortest first."""
        found, node = [], self.back
        while j:
            j -= 1
            node = node.get(word[j])
            if node is None:
                break
            if "" in node:
                found.append(node[""])
        return found

    def _extend_bpe(self, word: str, last: list, k: int) -> None:
        """last[j], for j from ``k`` + 1: the last piece of word[:j]; "" for a character without a piece."""
        back, stands, pieces_of = self.back, self.stands, self._stands
        for j in range(k, len(word)):
            node = back.get(word[j])
            if node is None:
                last.append("")
                continue
            found, i = [], j
            while True:
                piece = node.get("")
                if piece is not None:
                    found.append(piece)
                i -= 1
                if i < 0:
                    break
                node = node.get(word[i])
                if node is None:
                    break
            chosen = ""
            while found:
                piece = found.pop()
                left = last[j + 1 - len(piece)]
                if not left:
                    chosen = piece
                    break
                ok = stands.get(left + "\n" + piece)
                if ok or ok is None and pieces_of(left, piece):
                    chosen = piece
                    break
            last.append(chosen)

    def _step_unigram(self, word: str, last: list, j: int, sums: list) -> None:
        best, chosen = float("-inf"), ""
        for piece in reversed(self._ending(word, j)):
            s = sums[j - len(piece)] + self.pieces[piece][1]
            if s > best:
                best, chosen = s, piece
        if word[j - 1] not in self.pieces and sums[j - 1] + self.least > best:
            best, chosen = sums[j - 1] + self.least, ""
        last.append(chosen)
        sums.append(best)

    def encode_words(self, words: list[str]) -> None:
        """Adds the ids of ``words`` to what is known: one traversal of their trie."""
        unigram, previous = self.kind == "unigram", ""
        last, sums = [""], [0.0]
        for word in sorted(words):
            top = min(len(word), len(previous))
            k = 0
            while k < top and word[k] == previous[k]:
                k += 1
            del last[k + 1 :]
            if unigram:
                del sums[k + 1 :]
                for j in range(k + 1, len(word) + 1):
                    self._step_unigram(word, last, j, sums)
            else:
                self._extend_bpe(word, last, k)
            previous, ids, j = word, [], len(word)
            while j:
                piece = last[j]
                if piece:
                    ids.append(self.pieces[piece][0])
                    j -= len(piece)
                else:
                    raw = word[j - 1].encode("utf-8", "surrogatepass")
                    ids += [self.bytes[b] for b in reversed(raw)] if self.bytes else [self.unknown] if ids[-1:] != [self.unknown] else []
                    j -= 1
            self.known[word] = array("i", reversed(ids)).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        split = [self.words.findall(t) for t in marked] if self.cuts else [[t] if t else [] for t in marked]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.encode_words(list(set(chain.from_iterable(split)).difference(self.known)))
        known = self.known
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]

    def decode(self, ids) -> str:
        """The text of the pieces."""
        out = "".join(map(self.shown.__getitem__, ids))
        if _HIGH.search(out):
            out = "".join(part.encode("utf-8", "surrogateescape").decode("utf-8", "each-byte") for part in out.split(_BREAK))
        elif _BREAK in out:
            out = out.replace(_BREAK, "")
        # The mark that encoding put in front goes, whatever control ids stand before it.
        first = next((i for i in ids if i not in self.silent), None)
        if first is not None and first != self.unknown and self.text_of[first][:1] == MARK:
            out = out[1:]
        return out


def vocabulary(path: str, kind: str) -> Vocabulary:
    take_turn("sentencepiece", _LOADED.clear)
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Vocabulary(path, kind)
    return _LOADED[path, kind]


OUTPUTS = {"piece_ids": "array<int>", "n_pieces": "long", "ids_crc32": "long", "decoded_ok": "boolean"}


def encode(docs: DataFrame, model: str, *, text: str = "text", kind: str = "bpe", columns: list[str] | None = None, outputs: tuple[str, ...] = ("piece_ids",)) -> DataFrame:
    """``docs`` (or its ``columns``) with ``outputs``: piece_ids, their number n_pieces, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), decoded_ok (whether decoding the ids gives the text back)."""

    def column(name: str, ids: list[np.ndarray], texts: list[str], vocab: Vocabulary) -> pa.Array:
        if name == "piece_ids":
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
        if name == "n_pieces":
            return pa.array([len(x) for x in ids], pa.int64())
        if name == "ids_crc32":
            return pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
        return pa.array([vocab.decode(x.tolist()) == t.replace(MARK, " ") for x, t in zip(ids, texts, strict=True)])

    def fn(batches):
        vocab = vocabulary(model, kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [x or "" for x in part.column(text).to_pylist()]
                ids = vocab.encode(texts)
                yield part, [column(name, ids, texts, vocab) for name in outputs]

    keep = columns if columns is not None else docs.columns
    return add_columns(docs.select(*dict.fromkeys([*keep, text])), fn, [field(n, OUTPUTS[n]) for n in outputs], keep)


def decode(rows: DataFrame, model: str, *, ids: str = "piece_ids", kind: str = "bpe", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their pieces; null ids give null."""

    def fn(batches):
        vocab = vocabulary(model, kind)
        for batch in batches:
            yield batch, [pa.array([None if x is None else vocab.decode(x) for x in batch.column(ids).to_pylist()], pa.string())]

    return add_columns(rows, fn, [field(out, "string")])
