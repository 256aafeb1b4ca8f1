"""SentencePiece, near duplicates, nearest neighbours, token files and the pipeline against brute force."""

import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

import corpus_pipeline
from linewright.llm import ann, common, neardup, sentencepiece_trie, tokenfile
from linewright.llm.queries import ORACLES, PIECES, QUERIES, WORD_BPE
from linewright.session import materialise, scratch_path

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


# SentencePiece


@pytest.fixture(scope="module")
def vocab():
    return sentencepiece_trie.Vocabulary(PIECES)


def test_pieces_are_the_library_s(vocab):
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(3)
    alphabet = ["a", "b", "e", "t", "h", " ", "  ", "\n", "▁", "é", "日", "🙂", "\t", ".", "==", "____", "1", "The", "ing", "\x00", "́", "ﬁ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["", " ", "a" * 3000, "ab" * 2000, "=" * 1000, "the " * 2000]
    for ids, text in zip(vocab.encode(texts), texts, strict=True):
        assert ids.tolist() == library.encode(text), text
        assert vocab.decode(ids.tolist()) == text.replace("▁", " ")


def test_unigram_states_are_the_best_segmentation():
    rng = random.Random(1)
    for _ in range(60):
        pieces = {p: (k + 1, -rng.random() * 5) for k, p in enumerate({"".join(rng.choice("ab▁"[: 2 + (n == 0)]) for n in range(rng.randint(1, 4))) for _ in range(12)} | {"a", "b", "▁"})}
        own = sentencepiece_trie.Vocabulary(kind="unigram", pieces=pieces)
        for _ in range(20):
            text = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 9)))
            marked = "▁" + text.replace(" ", "▁")

            def best(s):
                return 0.0 if not s else max((pieces[s[:n]][1] + best(s[n:]) for n in range(1, min(4, len(s)) + 1) if s[:n] in pieces))

            ids = own.encode([text])[0].tolist()
            assert own.decode(ids) == text
            assert sum(pieces[own.text_of[i]][1] for i in ids) == pytest.approx(best(marked))


def test_unknown_characters_without_byte_pieces():
    own = sentencepiece_trie.Vocabulary(kind="unigram", pieces={"▁": (1, -1.0), "a": (2, -1.0)})
    assert own.encode(["azza"])[0].tolist() == [1, 2, 0, 2] and own.decode([1, 2, 0, 2]) == "a \u2047 a"


def test_viterbi_sums_are_the_best_of_the_whole_text(tmp_path, vocab):
    """The public pieces and scores as a unigram model: a plain table over whole texts finds no better sum."""
    own, rng = sentencepiece_trie.Vocabulary(PIECES, "unigram"), random.Random(23)
    longest = max(map(len, own.pieces))
    alphabet = ["a", "b", "e", "t", "h", " ", "  ", "\n", "▁", "é", "日", "🙂", "\t", ".", "==", "1", "The", "ing", "ӛ"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for ids, text in zip(own.encode(texts), texts, strict=True):
        marked = "▁" + text.replace(" ", "▁") if text else ""
        best = [0.0]
        for k in range(1, len(marked) + 1):
            sums = [best[a] + own.pieces[marked[a:k]][1] for a in range(max(0, k - longest), k) if marked[a:k] in own.pieces]
            best.append(max(sums + ([best[k - 1] + own.least] if marked[k - 1] not in own.pieces else [])))
        raw, total = bytearray(), 0.0
        for i in ids.tolist():  # bytes of a character without a piece cost its penalty once
            if i in own.byte_of:
                raw.append(own.byte_of[i])
            else:
                total += own.pieces[own.text_of[i]][1]
        assert own.decode(ids.tolist()) == text.replace("▁", " ") and total + own.least * len(raw.decode()) == pytest.approx(best[-1], abs=1e-3), text
    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(PIECES, "rb").read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="normalises"):
        sentencepiece_trie.Vocabulary(str(tmp_path / "other.model"))


def test_any_ids_are_decoded_as_by_the_library(vocab):
    library, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(9)
    for _ in range(6000):
        ids = [rng.choice((0, 1, 2, 259, 28705, rng.randrange(3, 259), rng.randrange(32_000))) for _ in range(rng.randint(0, 9))]
        assert vocab.decode(ids) == library.decode(ids), ids


def test_sentencepiece_frames(spark, vocab):
    docs = frame(spark, ["Hello  world", None, "", "x" * 100_000, "é\n"]).withColumn("N_pieces", F.lit("clash"))
    out = sentencepiece_trie.encode(docs, PIECES, outputs=("piece_ids", "n_pieces", "ids_crc32", "decoded_ok")).orderBy("doc_id")
    rows = out.collect()
    assert [r["n_pieces"] for r in rows][:3] == [3, 0, 0] and all(r["decoded_ok"] for r in rows)
    assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array(r["piece_ids"], "<u4").tobytes()) for r in rows]
    back = sentencepiece_trie.decode(out, PIECES).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == ["Hello  world", "", "", "x" * 100_000, "é\n"]
    twice = sentencepiece_trie.encode(docs.unionAll(docs), PIECES, outputs=("ids_crc32",))
    assert sorted(r["ids_crc32"] for r in twice.collect()) == sorted(2 * [r["ids_crc32"] for r in rows])
    assert sentencepiece_trie.encode(docs.limit(0), PIECES).count() == 0


# Near duplicates


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for v in range(len(texts)):
        for u in range(v):
            k = len(sets[u] & sets[v])
            if k and 100 * k >= 75 * len(sets[u] | sets[v]):
                a, b = sorted((find(u), find(v)))
                root[b] = a
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def near_texts(seed):
    rng = random.Random(seed)
    say = lambda n: [rng.choice(("tan", "lo", "RI", "é", "mek", "sun")) + str(rng.randint(0, 40)) for _ in range(n)]
    texts = []
    for _ in range(6):
        base = say(rng.randint(20, 120))
        for _ in range(14):  # copies around the threshold, some through one another
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 16))):
                words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 99))
            texts.append(rng.choice((" ", "\n", "\t")).join(words))
            if rng.random() < 0.5:
                base = words
    passage = say(40)
    texts += [" ".join(passage + say(rng.randint(5, 60))) for _ in range(30)]
    texts += [" ".join(say(rng.randint(1, 8))) for _ in range(20)]
    texts += [texts[0], texts[0].upper(), None, "", " \n ", "one", "ONE", "a b c d", "a b c d e", "w " * 5000, "w " * 300]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_brute_force(spark, seed):
    texts = near_texts(seed)
    got = neardup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    want = brute_components(texts)
    assert [(r["n_shingles"], r["component_id"]) for r in got] == want
    assert [r["kept"] for r in got] == [c == k for k, (_, c) in enumerate(want)]


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, "a b", 2), (2, "A  b", 3), (9, None, 4)], "doc_id long, text string, kept int")
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (2, 2, True), (3, 2, False), (3, 2, False), (9, 9, True)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    left = neardup.deduplicate(docs)
    assert left.columns == docs.columns and sorted(r["kept"] for r in left.collect()) == [1, 3, 4]


def test_a_hot_bucket_of_documents_just_below_the_threshold(spark):
    """Variations of one text: nearly all are candidates of one another, few are links."""
    rng = random.Random(4)
    texts = []
    for _ in range(260):
        words = [f"w{k}" for k in range(120)]
        for place in rng.sample(range(5, 115), rng.choice((2, 3, 3))):
            words[place] = f"v{rng.randrange(20)}"
        texts.append(" ".join(words))
    got = neardup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    want = brute_components(texts)
    assert [(r["n_shingles"], r["component_id"]) for r in got] == want
    assert 5 < len({c for _, c in want}) < 255


def test_rows_that_repeat_an_id(spark):
    """Equal rows are one document; of different texts the smallest set stands for the id; every row keeps its own size."""
    text = " ".join(f"w{k}" for k in range(40))
    near = text + " x"
    rows = [(7, text, "b"), (7, text, "a"), (7, text, "a"), (3, near, "c"), (9, near + " y z", "d"), (9, "only three words", "e"), (None, text, "f"), (None, text, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(docs).collect()))
    assert got == [(0, 36, 0, True), (0, 36, 0, True), (3, 37, 3, True), (7, 36, 3, False), (7, 36, 3, False), (7, 36, 3, False), (9, 1, 9, True), (9, 39, 9, True)]
    left = neardup.deduplicate(docs)
    assert sorted(r["mark"] for r in left.collect()) == ["c", "e", "f", "f"]
    same = spark.createDataFrame([(5, text, "z"), (5, text, "y"), (6, "else", "x")], docs.schema)
    assert sorted(r["mark"] for r in neardup.deduplicate(same).collect()) == ["x", "y"]


def test_tables_on_the_way_are_deleted(spark, monkeypatch):
    import linewright.session as session

    dropped = []
    monkeypatch.setattr(session, "drop_tables", lambda spark, paths: dropped.extend(paths))
    neardup.near_duplicates(frame(spark, near_texts(3)[:40]))
    assert len(dropped) > 10 and len(set(dropped)) == len(dropped)


def shuffled(spark, run):
    """(what ``run()`` returns, the bytes that the stages of its jobs write for shuffles)."""
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        context.listenerBus().waitUntilEmpty()
        listed = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in map(listed.apply, range(listed.size()))}

    last = max(stages(), default=-1)
    return run(), sum(n for k, n in stages().items() if k > last)


@pytest.mark.parametrize("again", [False, True])
def test_only_texts_of_buckets_and_groups_are_shuffled(spark, again):
    """Without broadcasts by size, as on large tables: neither the sets nor the rows that stay move all texts."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    rng = random.Random(6)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(2000)) for _ in range(120)]
    texts += [texts[k] + " and more" for k in range(6)]
    rows = list(enumerate(texts)) + ([(3, texts[3])] if again else [])
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string"), "shuffled")
    try:
        got, moved = shuffled(spark, lambda: materialise(neardup.deduplicate(docs), "left").select("doc_id").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r["doc_id"] for r in got) == list(range(120))
    assert moved < 0.8 * sum(map(len, texts))


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    """One word of 64 bits, all of them set: every row is only likely among the ids, the exact joins tell."""
    monkeypatch.setattr(common, "BITMAP_WORDS", 1)
    texts = near_texts(5)
    want = brute_components(texts)
    assert sorted(r["doc_id"] for r in neardup.deduplicate(frame(spark, texts)).collect()) == [k for k, (_, c) in enumerate(want) if c == k]


@pytest.mark.parametrize("words", [1, 3, 1 << 19])
def test_likely_among_misses_no_id(spark, monkeypatch, words):
    monkeypatch.setattr(common, "BITMAP_WORDS", words)
    rows = spark.range(-500, 500).unionAll(spark.sql("select cast(null as long)"))
    few = spark.range(-40, 400, 7).selectExpr("id as other").unionAll(spark.sql("select cast(null as long)"))
    likely, others = ([r["id"] for r in common.likely_among(rows, "id", few, how).collect()] for how in ("left_semi", "left_anti"))
    assert set(likely) >= set(range(-40, 400, 7)) and None not in likely and None in others
    assert sorted(x for x in likely + others if x is not None) == list(range(-500, 500))
    assert words < 9 or len(likely) < 70


def test_components_of_chains_and_stars(spark):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 560)}
    assert neardup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    for j in (0.75, 0.8, 0.9):
        n = 4000
        common = int(2 * n * j / (1 + j))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        far = [int(np.bitwise_count(neardup.sketch(np.sort(pool[:n]))[1] ^ neardup.sketch(np.sort(pool[n - common : 2 * n - common]))[1]).sum()) for pool in rng.integers(0, 1 << 63, (12, 2 * n), dtype=np.uint64)]
        k = neardup.BANDS * neardup.ROWS
        want = neardup.BITS / 2 * (1 - (1 - 2 / neardup.BITS) ** (2 * k * (1 - j)))
        assert abs(np.mean(far) - want) < 12 and max(far) <= neardup.FAR
        assert len(pool) == 2 * n


# Nearest neighbours


def brute_nearest(rows, k=10):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in ok:
        if q % 100 == 0:
            d = sorted((float(np.sqrt(np.cumsum((c - x) ** 2)[-1])), i) for i, c in ok if i != q and len(c) == len(x))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return sorted(out)


def test_nearest_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 97)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=24).astype(np.float32).tolist()) for k in range(900)]
    rows += [(k, rows[5][1]) for k in range(900, 960)] + [(k, [x * 1e3 for x in rows[k - 960][1]]) for k in range(960, 980)]
    rows += [(1000, rows[5][1]), (1100, None), (1101, [0.0] * 24), (1102, [float("nan")] * 24), (1103, [None] + [1.0] * 23), (1200, [float("inf")] * 24), (1300, [1.0, 2.0]), (1301, [1.0, 3.0]), (None, rows[0][1]), (1400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = ann.nearest(df, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_nearest(rows)
    assert ann.nearest(df, F.col("vec_id") == -1).count() == 0
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# Token files


ALPHABET = ["a", "B", "'s", "'ll", "'", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "é", "É", "́", "̱", "H", "日", "🙂", "Σ", ".", ",", "a.", "1", "<|endoftext|>", "<|EndOfText|>", "İ", "ß"]


def token_rows(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def read_back(spark, files):
    return sorted((tuple(r) for r in tokenfile.read_token_files(spark, files).collect()), key=lambda r: r[1])


def test_token_files_round_trip(spark):
    library = Tokenizer.from_file(WORD_BPE)
    texts = [*token_rows(1, 600), None, "", "long " * 30_000, "x" * 50_000]
    rows = [(k * 7 % 1000 - 300, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "no id")], "doc_id long, text string").withColumn("n_tokens", F.lit("x"))
    path = scratch_path(spark, "tokens-test")
    files = tokenfile.write_token_files(docs, WORD_BPE, path)
    ids = {k: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for k, t in [*rows, (None, "no id")]}
    want, start = [], 0
    for k in [*sorted(k for k, _ in rows), None]:
        want.append((k, start, len(ids[k]), zlib.crc32(ids[k].tobytes())))
        start += len(ids[k])
    assert read_back(spark, files) == want
    assert sum(n for _, n, _ in files) == len(want) and sum(n for _, _, n in files) == start
    found = 0
    for name, _, _ in files[:-1]:
        reader = tokenfile.Reader(name)
        for k in reader.table["doc_id"][:5].tolist():
            assert reader.ids(k).tolist() == ids[k].tolist()
            found += 1
    assert found
    with pytest.raises(KeyError):
        reader.ids(10**9)
    with pytest.raises(KeyError):
        tokenfile.Reader(files[-1][0]).ids(0)
    local = tokenfile.open_fs(name)[1]
    raw = bytearray(open(local, "rb").read())
    raw[int(reader.table["offset"][-1]) + 3] ^= 1
    open(local, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged frame"):
        tokenfile.Reader(name).ids(int(reader.table["doc_id"][-1]))
    raw[-1] ^= 1
    open(local, "wb").write(raw)
    with pytest.raises(ValueError, match="damaged table"):
        tokenfile.Reader(name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_tokenizer_gives_its_own_ids(name):
    path = public_tokenizers.path(name)
    library, own = Tokenizer.from_file(path), tokenfile.ChunkEncoder(path)
    assert own.whole is (name != "word_bpe_49k.json")
    texts = ["Hello  World", "a  b", *(a + b for a in "HJTWYÅ" for b in "\u0331\u030c\u0308\u030a\u0327"), *token_rows(5, 800)]
    ids, starts = own(pa.array(texts), 1)
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text


def test_words_are_encoded_once_in_any_case_and_beside_any_sign(monkeypatch):
    """The library gets each match of its pattern once, many in one text; ids of matches that are kept together stay the library's."""
    library, own, given = Tokenizer.from_file(WORD_BPE), tokenfile.ChunkEncoder(WORD_BPE), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return library.encode_batch_fast(texts, **options)

    own.tokenizer = Counting()
    words = [a + b + c for a in "abcdefgh" for b in "aeioué" for c in ("n", "st", "ß", "ç")]
    texts = [f"{x} {x.upper() if 'ß' not in x else x}, {x}$$$ ({x}) {x}.### {x}-{x}! {x}'s 4{x}20" for x in words]
    marks = ["a\u0958b", "İ, x", "×, ÷. é× x", "'s's 's-'s ''s", "12.5-'re", "<|endoftext|>a$ <|", "é\u0301, H\u0331.", "a\x1c.b\x85,", "x" * 120 + ",", "", " "]
    for batch in (texts, texts, marks * 3, [], marks + texts):
        ids, starts = own(pa.array(batch, pa.string()), 1)
        assert len(starts) == len(batch) + 1
        for text, a, b in zip(batch, starts[:-1], starts[1:], strict=True):
            assert ids[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text
        if batch is texts:
            assert len(given) <= 30 and len(own.known) <= len(words) + 15
    monkeypatch.setattr(tokenfile, "REMEMBERED", 20)
    for batch in (texts, marks, texts):
        ids, _ = own(pa.array(batch, pa.string()), 1)
        assert ids.tolist() == [k for t in batch for k in [*library.encode(t, add_special_tokens=False).ids, 1]]
        assert len(own.known) <= 20


def test_ranges_and_files_are_bounded(spark):
    """A repeated id goes over several ranges, a full file is followed by another, and the order stays."""
    rows = [(5, f"word {k}") for k in range(90)] + [(k, "a b c") for k in range(40)] + [(None, f"none {k}") for k in range(60)]
    files = tokenfile.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORD_BPE, file_docs=7, range_bytes=300)
    assert len(files) >= len(rows) / 7 and max(n for _, n, _ in files) <= 7
    got = read_back(spark, files)
    assert [r[0] for r in got] == [*sorted(k for k, _ in rows if k is not None), *[None] * 60]
    library = Tokenizer.from_file(WORD_BPE)
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted((r[0] is None, r[0] or 0, r[3]) for r in got) == sorted((k is None, k or 0, crc(t)) for k, t in rows)
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    ids, marks = pa.array([1, 5, 5, 5, 9, None, None]), np.array([0, 0, 1 << 31, (1 << 32) - 1, 5, 0, (1 << 32) - 1])
    assert tokenfile.range_of(ids, marks, np.array([5, 5, 7]), 2).tolist() == [0, 0, 1, 1, 3, 4, 5]


def test_token_file_edges(spark):
    empty = frame(spark, [])
    assert tokenfile.read_token_files(spark, tokenfile.write_token_files(empty, WORD_BPE)).count() == 0
    twice = spark.createDataFrame([(5, "a"), (5, "a"), (4, None)], "doc_id long, text string")
    got = tokenfile.read_token_files(spark, tokenfile.write_token_files(twice, WORD_BPE)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(4, 0, 1), (5, 1, 2), (5, 3, 2)]
    unnamed = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")
    assert [r[:3] for r in read_back(spark, tokenfile.write_token_files(unnamed, WORD_BPE))] == [(None, 0, 2), (None, 2, 2)]
    wide = np.array([70_000, 2], np.uint32)
    assert tokenfile.unframe(tokenfile.frame(wide, tokenfile.zstandard.ZstdCompressor()), 2).tolist() == [70_000, 2]


# Queries and pipeline


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda rows, names: sorted(([r[names.index(c)] for c in columns] for r in rows), key=str)
    assert key([tuple(r) for r in got.collect()], got.columns) == key(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    source, key = ("pages", "page_id") if name.startswith("op5") else ("documents", "doc_id")
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{source}.parquet").select(key).collect())
    assert sorted(r[key] for r in QUERIES[name](spark, SF).collect()) == want


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_benchmark(text, items, width=8):
    """(items found, the text without their windows) from every window of every item."""
    spans = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    w = [text[a:b].translate(LOWER) for a, b in spans]
    hit, found = set(), set()
    for item, grams in items:
        for k in range(len(w)):
            for g in grams:
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found.add(item)
    out, at, k = [], 0, 0
    while k < len(w):
        if k in hit:
            end = k
            while end + 1 in hit:
                end += 1
            out.append(text[at : spans[k][0]])
            at, k = spans[end][1], end
        k += 1
    return found, "".join(out) + text[at:]


def grams_of(text, width=8):
    w = WORD.findall(text.translate(LOWER))
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


PERSONAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|\+[0-9][\x20().0-9-]{6,}[0-9]")


def naive_score(model, raw):
    """The classifier's score from the set of a text's n-grams, each looked up by itself."""
    from linewright.llm import toxicity

    line = (" " + " ".join(WORD.findall(raw.decode("latin-1").translate(LOWER))) + " ").encode("latin-1")
    held = set()
    for n in toxicity.SIZES:
        for k in range(len(line) - n + 1):
            held.add(((int.from_bytes(line[k : k + n], "big") * 0x9E3779B97F4A7C15) % (1 << 64) ^ (n << 60)) >> (64 - toxicity.BITS))
    return 1 / (1 + np.exp(-(model.bias + sum(float(model.weights[b]) for b in held))))


def test_pipeline_stage_by_stage(spark):
    """Every stage's rows follow from its input: brute force for each, apart from the operators' own functions."""
    from linewright.llm import pii, toxicity
    from linewright.llm.queries import table

    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    weights = dict(pii.train())
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = materialise(stage(spark, docs, SF), "test-stage")
        after = {r["doc_id"]: r for r in out.collect()}
        kept[name] = len(after)
        assert set(after) <= set(before)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        if name == "toxicity":
            model = toxicity.train(docs, table(spark, SF, "labels"))
            some = [k for k, r in before.items() if len(r["text"]) < 4000]
            assert len(some) > 100 and {k for k in some if naive_score(model, before[k]["text"].encode()) < 0.3} == set(after) & set(some)
        elif name == "near duplicates":
            ids = sorted(before)
            parts = brute_components([before[k]["text"] for k in ids])
            assert set(after) == {ids[k] for k, (_, c) in enumerate(parts) if c == k}
        elif name == "benchmark decontamination":
            items = [(str(r["item_id"]), grams_of(r["text"])) for r in table(spark, SF, "benchmark").collect()]
            of = {}
            for item, grams in items:
                for g in grams:
                    of.setdefault(g, set()).add(item)
            for k, r in before.items():
                # Only items with a window in the text are worth the slow way.
                w = WORD.findall(r["text"].translate(LOWER))
                near = {i for n in {len(g) for g in of} for a in range(len(w) - n + 1) for i in of.get(tuple(w[a : a + n]), ())}
                found, left = brute_benchmark(r["text"], [x for x in items if x[0] in near])
                assert found == near and (k in after) == (len(found) < 2)
                if k in after:
                    assert after[k]["text"] == left
        elif name == "personal data":
            assert set(after) == set(before)
            for k, r in after.items():
                text = before[k]["text"]
                assert r["text"] == pii.redacted(text, sorted(set(pii.base_spans(text)) | set(pii.find(text, weights)[1])))
                assert not PERSONAL.search(r["text"]) or not any(8 <= sum(c.isdigit() for c in m.group()) <= 15 or "@" in m.group() for m in PERSONAL.finditer(r["text"]))
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
            assert set(after) == set(before)
            assert all(r["piece_ids"] == library.encode(before[k]["text"]) for k, r in after.items())
        docs = out
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(r["doc_id"] for r in ran.select("doc_id").collect()) == sorted(after)
    assert kept["personal data"] == kept["SentencePiece encoding"] > 0


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows and columns that are called like the operators' own come through; an empty table gives no row."""
    text = " ".join(f"plain{k}" for k in range(30))
    rows = [(1, text, None, 5.5), (1, text, "b", 5.5), (2, text + " more", "c", 1.5), (None, None, None, None), (None, "mail ann@b.org", "d", 2.5), (4, "", "e", 0.5)]
    own = "doc_id long, text string, Score string, n_words double"
    schema = f"{own}, predicted string, held_out string, base_spans string, item_ids string, contaminated string, n_hit string, n_chars int"
    docs = spark.createDataFrame([(*r, *(["kept"] * 6), 9) for r in rows], schema)
    for now in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = materialise(stage(spark, now, SF), "edges")
            assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema], name
        got = corpus_pipeline.STAGES[-1][1](spark, now, SF)
        assert set(got.columns) == (set(docs.columns) - {"text"}) | {"piece_ids", "n_pieces"}
        found = sorted((tuple(r) for r in now.select("doc_id", "text", "Score", "n_words", "n_chars", "predicted").collect()), key=str)
        if found:
            assert found == sorted([(1, text, None, 5.5, len(text), "kept"), (None, None, None, None, 0, "kept"), (None, "mail <EMAIL>", "d", 2.5, 12, "kept"), (4, "", "e", 0.5, 0, "kept")], key=str)
            assert sorted(r["n_pieces"] for r in got.collect())[:2] == [0, 0]
        else:
            assert got.count() == 0
