"""MinHash near-duplicate detection with odd sketches; links are confirmed on the full sets.

A document's set holds its distinct shingles of ``width`` words (all words as one, if there are
fewer). The steps:

1. Sketch (no shuffle): ``BANDS`` x ``ROWS`` minima, folded into one key for each band, and an odd
   sketch: every (number, minimum) pair flips one bit of ``BITS``. Two documents' sketches differ in
   about as many bits as their minima, so the XOR's population count estimates high similarities well.
2. Documents with equal sets form a class; its smallest id stands for it from here on.
3. Classes with an equal key are candidates. Each is compared with the smallest of its bucket, so a
   bucket of m gives m - 1 pairs. A sketch distance over ``FAR`` (5 standard deviations beyond the
   threshold) ends a pair; the others are confirmed on their full sets.
4. Components of the confirmed links. The members of buckets that still hold several components
   form a pool. A bucket may be hot, so its members are not compared with one another: their shingles
   are put in order, rarest in the pool first, and two documents can only be linked if they share one
   of the few that stand first (prefix filter), far enough in front in both (positional filter). The
   join on those shingles keeps pairs of different components whose sizes and sketches agree; only
   ids leave it, each pair once, and then the full sets confirm.
5. Components again, over the components; every document gets the smallest id of its own.

With 48 bands of 5 a pair at the threshold of 0.75 shares no key with probability 2e-6, at 0.8 less
than 1e-8. Nothing caps a bucket or a class. Everything past step 1 handles keys, ids and counts,
except the sets of documents in buckets of two or more, which are written once. Whole texts are
shuffled only of documents that a broadcast bitmap of bounded size says may be in such buckets; so are
whole rows that may go or repeat an id in :func:`deduplicate`. Tables on the way are deleted when the
result is written.

Defined results: without words or text a document's set is empty and it is linked with nothing; a
null id is linked with nothing, has no component and is kept; rows that repeat an id all get the
component of that id, of whose texts the one with the smallest set (by size, then hash) is compared; a text of any length has its whole set; ties need no order, as a component
is its smallest id; an empty table gives no row. Input columns named like an output column give way
to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import LOWER, distinct, likely_among, raw_texts, take_turn
from linewright.session import Scratch, materialise, ship_package

BANDS, ROWS, BITS = 48, 5, 1024
#: Bits in which two sketches at a similarity of 0.75 differ: 107 on average, standard deviation 12.
FAR = 167
CHUNK = 1 << 20
#: Shares that the rows of one class are dealt over.
SALTS = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_MIX = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)
_BASE = np.uint64(0x9DDFEA08EB382D69)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, CHUNK) + 64, _BASE, np.uint64))))
    return _POWERS


def shingle_sets(raws: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of every text's set."""
    data = np.frombuffer(b"\n".join([*raws, b""]).translate(LOWER), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return [np.zeros(0, np.uint64)] * len(raws)
    # A word's hash: its bytes by powers of the base, from its own first byte on.
    size = end - begin
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    letters = data[~_SPACE[data]].astype(np.uint64) + np.uint64(1)
    word = _mix(np.add.reduceat(letters * _powers(int(size.max()))[place], np.cumsum(size) - size) + size.astype(np.uint64) * _MIX[15])
    owner = np.searchsorted(starts, begin, side="right") - 1
    counts = np.bincount(owner, minlength=len(raws))
    first = np.cumsum(counts) - counts
    n = len(word) - width + 1
    if n > 0:
        code = word[:n] * _MIX[0]
        for k in range(1, width):
            code = code + word[k : k + n] * _MIX[k]
        code = _mix(code)
    out = []
    for f, c in zip(first.tolist(), counts.tolist(), strict=True):
        if c >= width:
            out.append(distinct(code[f : f + c - width + 1]))
        elif c:
            out.append(_mix((word[f : f + c] * _MIX[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a key for each band, the odd sketch as 64-bit words)."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 256):
        np.minimum(least, ((short[at : at + 256, None] ^ _ADD) * _MULTIPLY).min(axis=0), out=least)
    number = np.arange(BANDS * ROWS, dtype=np.uint64)
    sample = _mix(least.astype(np.uint64) << np.uint64(16) | number)
    keys = _mix((sample.reshape(BANDS, ROWS) * _MIX[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    bits = np.bincount((sample % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return keys, np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _sum(shingles: np.ndarray) -> int:
    """A hash of the set: the sum of its members' mixed hashes."""
    return int(_mix(shingles).sum(dtype=np.uint64).view(np.int64))


def text_chunks(raws: list[bytes]):
    at = 0
    while at < len(raws):
        end, total = at, 0
        while end < len(raws) and (end == at or total + len(raws[end]) <= CHUNK):
            total += len(raws[end])
            end += 1
        yield at, end
        at = end


def _each(batch: pa.RecordBatch, width: int):
    raws = [x or b"" for x in raw_texts(batch, "t")]
    for at, end in text_chunks(raws):
        yield from shingle_sets(raws[at:end], width)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)))


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(id, n, s1, s2, keys, odd) of every (id, t): size of the set, its 128-bit hash, band keys, odd sketch."""

    def run(batches):
        take_turn("neardup")
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                n, s1, s2, keys, odd = [], [], [], [], []
                for s in _each(batch, width):
                    n.append(len(s))
                    s1.append(_sum(s))
                    s2.append(_sum(s ^ _MIX[9]))
                    k, o = sketch(s) if len(s) else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
                    keys.append(k)
                    odd.append(o)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _lists(keys), _lists(odd)], names=["id", "n", "s1", "s2", "keys", "odd"])

    return texts.mapInArrow(run, "id long, n long, s1 long, s2 long, keys array<long>, odd array<long>")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(id, members, s1) of every (id, t); s1 as :func:`sketches` has it."""

    def run(batches):
        take_turn("neardup")
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = list(_each(batch, width))
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found), pa.array([_sum(s) for s in found], pa.int64())], names=["id", "members", "s1"])

    return texts.mapInArrow(run, "id long, members array<long>, s1 long")


def components(edges: DataFrame, write=materialise) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the smallest node it reaches.

    Alternates large-star and small-star steps; a hot node's edges are only summed up and joined,
    and each round is written to the shared folder, by ``write``.
    """
    now = write(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    print_of = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
    before = print_of(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        now = write(small, "edges")
        after = print_of(now)
        before, same = after, before == after
        if same:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _distance(a: str, b: str):
    """Bits in which two odd sketches differ."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(1, BITS // 64)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (u, v) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("id").alias("u"), F.col("members").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("members").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, "u").join(right, "v").where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v")


def open_pairs(pool: DataFrame, sets: DataFrame, slim: DataFrame, percent: int, write) -> DataFrame:
    """Pairs (u, v) of documents of the ``pool`` (id, c), of different c, that size, prefix, position and sketch let be links."""
    tokens = sets.join(pool, "id").select("id", F.explode("members").alias("s"))
    # A shingle that one document of the pool holds is in no intersection: it only takes up a place in front.
    counts = write(tokens.groupBy("s").agg(F.count("*").alias("k")).where("k > 1"), "shingles")
    ranked = tokens.join(counts, "s").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("by_rank"))
    own = ranked.join(slim, "id").join(pool, "id").withColumn("lone", F.col("n") - F.size("by_rank"))
    # With a partner of any size at least percent of n are shared, with a larger one 2 percent / (100 + percent).
    room = lambda above, below: F.col("n") - F.expr(f"(n * {above} + {below - 1}) div {below}") + 1
    own = own.withColumns({"wide": room(percent, 100), "narrow": room(2 * percent, 100 + percent)}).where("wide > lone")
    heads = F.slice("by_rank", F.lit(1), (F.col("wide") - F.col("lone")).cast("int"))
    postings = write(own.select("id", "c", "n", "narrow", "lone", "odd", F.posexplode(heads).alias("j", "x")).select("id", "c", "n", "narrow", "odd", (F.col("lone") + F.col("j")).alias("at"), F.col("x.s").alias("s")), "postings")
    side = lambda x: [F.col(c).alias(c + x) for c in ("id", "c", "n", "odd", "at")]
    less, more = postings.where("at < narrow").select("s", *side("u")), postings.select("s", *side("v"))
    ordered = (F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("idu") < F.col("idv")))
    left = F.least(F.col("nu") - F.col("atu"), F.col("nv") - F.col("atv"))
    fits = (100 * F.col("nu") >= percent * F.col("nv")) & ((100 + percent) * left >= percent * (F.col("nu") + F.col("nv")))
    met = less.alias("x").join(more.alias("y"), (F.col("x.s") == F.col("y.s")) & (F.col("cu") != F.col("cv")) & ordered & fits & (_distance("oddu", "oddv") <= FAR))
    return met.select(F.col("idu").alias("u"), F.col("idv").alias("v")).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    with Scratch(docs.sparkSession) as tables:
        rows = materialise(_components_of(texts, width, percent, tables.write), "near-duplicates")
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _components_of(texts: DataFrame, width: int, percent: int, write) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every (id, t)."""
    all_sketches = write(sketches(texts, width), "sketches")
    linkable = all_sketches.where("n > 0 and id is not null")
    repeated = write(texts.where("id is not null").groupBy("id").agg(F.count("*").alias("_k")).where("_k > 1").select("id"), "repeated")
    once = repeated.isEmpty()
    if not once:
        lowest = linkable.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("n", "s1", "s2", "keys", "odd")).alias("x")).select("id", "x.*")
        linkable = write(linkable.join(repeated, "id", "left_anti").select(*all_sketches.columns).unionAll(lowest.select(*all_sketches.columns)), "linkable")
    # Equal sets: the smallest id stands for the class. A class can hold a third of all rows, so it is
    # dealt over SALTS shares: first the smallest id of a share, then that of the shares, and back.
    linkable = linkable.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    shares = linkable.groupBy("n", "s1", "s2", "share").agg(F.min("id").alias("low"))
    classes = shares.join(shares.groupBy("n", "s1", "s2").agg(F.min("low").alias("rep")), ["n", "s1", "s2"]).drop("low")
    of_class = write(linkable.join(classes, ["n", "s1", "s2", "share"]).select("id", "rep", "n", "s1", F.when(F.col("id") == F.col("rep"), F.col("keys")).alias("keys"), F.when(F.col("id") == F.col("rep"), F.col("odd")).alias("odd")), "classes")
    reps = of_class.where("keys is not null")

    # Candidates: members of buckets of two or more, each with the smallest of its bucket.
    keyed = reps.select(F.explode("keys").alias("key"), "id")
    # Written tables of a row for each bucket: the joins with them can split the rows of a hot key.
    hubs = write(keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("_max"), F.count("*").alias("m")).where("hub != _max").drop("_max"), "hubs")
    members = write(keyed.join(hubs, "key").select("key", "id", "hub", "m").distinct(), "members")
    stars = members.where("id != hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    slim = reps.select("id", "n", "odd")
    near = stars.join(slim.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("odd").alias("a")), "u").join(slim.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("odd").alias("b")), "v").where((100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")) & (_distance("a", "b") <= FAR)).select("u", "v")
    # Few texts are in buckets: only those and the few that share a bit of the bitmap are shuffled.
    in_buckets = write(members.select("id").distinct(), "in-buckets")
    found = full_sets(likely_among(texts, "id", in_buckets).join(in_buckets, "id", "left_semi"), width)
    if not once:
        found = found.join(reps.select("id", "s1"), ["id", "s1"], "left_semi").groupBy("id").agg(F.min("members").alias("members"))
    sets = write(found.select("id", "members"), "sets")
    links = write(confirmed(near, sets, percent), "links")
    first = write(components(links, write), "components")

    # What is left: buckets of three or more that still hold several components.
    whole = members.where("m > 2").join(first, F.col("id") == F.col("node"), "left").select("key", "id", "hub", F.coalesce("component", "id").alias("c"))
    several = write(whole.groupBy("key").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low != _high").select("key"), "several")
    pool = write(whole.join(several, "key").where("id != hub").groupBy("id").agg(F.min("c").alias("c")), "pool")
    more = write(confirmed(open_pairs(pool, sets, slim, percent, write), sets, percent), "more")
    bridged = more.join(first.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(first.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    second = components(bridged, write)
    of_rep = first.select(F.col("node"), F.col("component").alias("c")).unionAll(second.join(first, "node", "left_anti").select("node", F.col("node").alias("c")))
    final = of_rep.join(second.select(F.col("node").alias("c"), F.col("component")), "c", "left").select(F.col("node").alias("rep"), F.coalesce("component", "c").alias("component"))

    # An id that many rows repeat is one row here, and rows without an id are left out of the join.
    ids = write(of_class.select(F.col("id").alias("_id"), "rep").distinct().join(final, "rep", "left").groupBy("_id").agg(F.min(F.coalesce("component", "rep")).alias("component")), "ids")
    named = all_sketches.where("id is not null").select("id", "n").join(ids, F.col("id") == F.col("_id"), "left")
    out = named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.unionAll(all_sketches.where("id is null").select("id", "n", "id"))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of each component: that of its smallest id, of rows that repeat it the first in the order of all columns.

    Rows without an id stay.
    """
    gone = near_duplicates(docs, doc_id=doc_id, **options).where("not kept").select(F.col("doc_id").alias(doc_id)).distinct()
    repeated = materialise(docs.groupBy(F.col(doc_id)).agg(F.count("*").alias("_n")).where(F.col(doc_id).isNotNull() & (F.col("_n") > 1)).select(doc_id), "repeated")
    # Most rows neither go nor repeat an id: they pass without a shuffle.
    touched = gone.unionAll(repeated.select(F.col(doc_id).cast("long")))
    passed, open_rows = likely_among(docs, doc_id, touched, "left_anti"), likely_among(docs, doc_id, touched)
    left = open_rows.join(gone, doc_id, "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return passed.unionAll(left)
    once = left.join(repeated, doc_id, "left_semi").select(doc_id, F.struct(*docs.columns).alias("_row")).groupBy(doc_id).agg(F.min("_row").alias("_row")).select("_row.*")
    return passed.unionAll(left.join(repeated, doc_id, "left_anti").select(*docs.columns)).unionAll(once.select(*docs.columns))
