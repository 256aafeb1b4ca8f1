"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are read as bytes with ASCII letters lower-cased; every run of other ASCII bytes counts as
one space, and a space stands at both ends. The features of a text are which n-grams it holds (not
how often), hashed into buckets. A bucket's log-count ratio r compares how many toxic and other
training texts hold it; the ``features`` buckets whose ratio says most stay, and logistic
regression learns weights for features x_j * r_j. A score is the sigmoid of the sum.

Training takes at most ``max_rows`` labelled ids, those with the smallest hash, and of these, in the
order of the hash, as many as ``max_bytes`` of text hold: the same at any partitioning, and a bound
on what comes to the driver. Scoring covers every whole text and has no shuffle.

Defined results: a null or empty text has no features and gets the score of the bias alone; a text
of any length is scored whole; label rows without id or label are ignored, of repeated ones the
largest label counts; of documents that repeat an id the smallest text is learnt from, and each of
them is scored; rows without an id are scored and not held out; without both labels in the training
rows every score is 0 or 1, whichever label there is (0 without rows); an empty table gives no row.
Input columns named like an output column give way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import WORDS, add_columns, distinct, field, raw_texts, take_turn
from linewright.session import Scratch

#: Bits of a bucket number; n-gram lengths in bytes; buckets that stay; rows and bytes of text the classifier is fitted on.
BITS, SIZES, FEATURES, MAX_ROWS, MAX_BYTES = 20, (4, 5, 6), 4096, 8_000, 64 << 20
#: Bytes hashed at once.
CHUNK = 1 << 19


def _packed(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, words set apart by single spaces, and where each begins (one more: the end)."""
    parts = [b" " + b" ".join(r.translate(WORDS).split()) + b" " for r in raws]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def grams(data: np.ndarray, starts: np.ndarray, sizes: tuple = SIZES, bits: int = BITS):
    """For each size: (bucket of every n-gram, number of the text it stands in)."""
    owner = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    wide = data.astype(np.uint64)
    run = wide
    for n in range(2, min(max(sizes), len(data)) + 1):
        run = run[:-1] << np.uint64(8) | wide[n - 1 :]
        if n not in sizes:
            continue
        bucket = ((run * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(n) << np.uint64(60)) >> np.uint64(64 - bits)).astype(np.int32)
        inside = owner[: len(bucket)] == owner[n - 1 :]
        if inside.all():
            yield bucket, owner[: len(bucket)]
        else:
            yield bucket[inside], owner[: len(bucket)][inside]


def chunks(raws: list[bytes], size: int = CHUNK):
    at = 0
    while at < len(raws):
        end, total = at, 0
        while end < len(raws) and (total == 0 or total + len(raws[end]) <= size):
            total += len(raws[end]) + 2
            end += 1
        yield at, end
        at = end


class Model:
    """weights: of all buckets, 0 for those that are no feature."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, raws: list[bytes]) -> np.ndarray:
        out = np.full(len(raws), self.bias, np.float64)
        for at, end in chunks(raws):
            data, starts = _packed(raws[at:end])
            for bucket, owner in grams(data, starts):
                w = self.weights[bucket]
                hit = np.flatnonzero(w)
                if len(hit):
                    # Each feature of a text counts once.
                    key = distinct(owner[hit].astype(np.int64) << BITS | bucket[hit])
                    out[at:end] += np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)], end - at)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def fit(texts: list[bytes], labels: np.ndarray, features: int = FEATURES, steps: int = 300) -> Model:
    """The classifier of the given texts; ``labels`` are 0 or 1."""
    n, size = len(texts), 1 << BITS
    positive = int(labels.sum())
    if positive in (0, n):
        share = positive / n if n else 0.0
        return Model(np.zeros(size, np.float32), 50.0 if share == 1 else -50.0)
    held = [np.zeros(size, np.int32), np.zeros(size, np.int32)]
    for at, end in chunks(texts):
        data, starts = _packed(texts[at:end])
        for bucket, owner in grams(data, starts):
            key = distinct(owner.astype(np.int64) << BITS | bucket)
            toxic = labels[at + (key >> BITS)] == 1
            for k in (0, 1):
                held[k] += np.bincount((key & (size - 1))[toxic == bool(k)], minlength=size).astype(np.int32)
    # Log-count ratio, drawn towards 0 where few texts hold the n-gram.
    ratio = np.log((held[1] + 1) / (positive + 2)) - np.log((held[0] + 1) / (n - positive + 2))
    gain = np.where(held[0] + held[1] >= 5, np.abs(ratio) * np.sqrt(held[1] + held[0]), 0)
    chosen = np.sort(np.argpartition(-gain, features)[:features])
    chosen = chosen[gain[chosen] > 0]
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    rows, cols = [], []
    for at, end in chunks(texts):
        data, starts = _packed(texts[at:end])
        for bucket, owner in grams(data, starts):
            where = place[bucket]
            hit = np.flatnonzero(where >= 0)
            key = distinct(owner[hit].astype(np.int64) << 32 | where[hit])
            rows.append(at + (key >> 32))
            cols.append(key & 0xFFFFFFFF)
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    r = ratio[chosen]
    w, b, y = np.zeros(len(chosen)), float(np.log(positive / (n - positive))), labels.astype(np.float64)
    scale, m, v = r[cols], np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for step in range(1, steps + 1):  # Adam on the whole sample; L2 pulls the weights to 0
        z = np.bincount(rows, w[cols] * scale, n) + b
        d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
        g = np.append(np.bincount(cols, d[rows] * scale, len(chosen)) + 1e-4 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(size, np.float32)
    weights[chosen] = w * r
    return Model(weights, b)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on the labelled rows that :func:`held_out` leaves: ``max_rows`` ids and ``max_bytes`` of text at most."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "i")  # max_rows at most
    rows = rows.groupBy("i").agg(F.min("t").alias("t"), F.max("y").alias("y")).select(F.xxhash64("i").alias("h"), "i", "y", "t", F.octet_length("t").alias("n"))
    with Scratch(docs.sparkSession) as tables:
        rows = tables.write(rows, "toxicity-sample")
        # Sizes first, a row for each id; then the texts up to the first that goes beyond the bound.
        sizes = sorted((r["h"], r["i"], r["n"]) for r in rows.select("h", "i", "n").collect())
        total = np.cumsum([n for _, _, n in sizes])
        keep = int(np.searchsorted(total, max_bytes, "right"))
        if not keep:
            return fit([], np.zeros(0, np.int64))
        last = F.struct(F.lit(sizes[keep - 1][0]).alias("h"), F.lit(sizes[keep - 1][1]).alias("i"))
        taken = sorted((r["i"], bytes(r["t"]), int(r["y"] == 1)) for r in rows.where(F.struct("h", "i") <= last).select("i", "y", F.col("t").cast("binary").alias("t")).collect())
    return fit([t for _, t, _ in taken], np.array([y for _, _, y in taken], np.int64))


def score_toxicity(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with held_out, score and predicted."""
    chosen = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((chosen.astype(np.int32), model.weights[chosen], model.bias))

    def fn(batches):
        take_turn("toxicity")
        places, weights, bias = shared.value
        full = np.zeros(1 << BITS, np.float32)
        full[places] = weights
        own = Model(full, bias)
        for batch in batches:
            yield batch, [pa.array(own.score([x or b"" for x in raw_texts(batch, text)]), pa.float64())]

    keep = columns if columns is not None else docs.columns
    narrow = docs.select(*dict.fromkeys([*keep, doc_id, text]))
    out = add_columns(narrow, fn, [field("score", "double")], list(dict.fromkeys([*keep, doc_id])))
    return out.withColumns({"held_out": F.coalesce(held_out(F.col(doc_id)), F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})
