"""Decontamination, personal data, licenses, toxicity, HTML and URL rules against brute force and small cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import decontaminate, htmltext, licenses, pii, toxicity, urlfilter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema="doc_id long, text string"):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], schema)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# Decontamination


def brute_decontamination(texts, items, width=8):
    grams = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - width + 1) if w and item is not None else 0):
            grams.setdefault(tuple(w[k : k + width]), set()).add(str(item))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for k in range(len(w)):
            for n in {len(g) for g in grams}:
                g = grams.get(tuple(w[k : k + n])) if k + n <= len(w) else None
                if g:
                    hit |= set(range(k, k + n))
                    found |= g
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("pattern_bytes", [1 << 20, 200])
def test_decontamination_is_brute_force(spark, pattern_bytes):
    rng = random.Random(4)
    vocab = ["a", "B", "cé", "d1", "ÉE"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(rng.choice((1, 3, 5, 6, 9)))) for k in range(12)] + [(3, "a b"), (None, "a"), (50, None), (51, "!!"), (52, "a B cé"), (53, "a B cé")]
    texts = [say(rng.randint(0, 40)) for _ in range(60)] + [None, "", "?!", "a" * 100_000, " ".join(["a"] * 5000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, texts), bench, width=5, pattern_bytes=pattern_bytes).orderBy("doc_id").collect()
    want = brute_decontamination(texts, items, 5)
    assert [(r["n_words"], r["n_hit"], r["item_ids"]) for r in got] == want
    assert [r["contaminated"] for r in got] == [len(w[2]) >= 2 for w in want]
    for r in got:
        spans = [r["text"][s["start"] : s["end"]] for s in r["hit_spans"]]
        assert sum(len(words(s)) for s in spans) == r["n_hit"]


def test_blocks_that_many_items_share(spark, monkeypatch):
    """Items around the same passages, compared in small lots: hits only where whole windows stand."""
    monkeypatch.setattr(decontaminate, "COMPARED", 5)
    rng = random.Random(14)
    words_ = [f"w{k}" for k in range(9)]
    passage = [rng.choice(words_) for _ in range(30)]
    items = []
    for k in range(60):
        a, n = rng.randrange(25), rng.randint(3, 20)
        items.append((str(k), [rng.choice(words_) for _ in range(rng.randint(0, 6))] + passage[a : a + n] + [rng.choice(words_)]))
    index = decontaminate.Index([(k, " ".join(w).encode()) for k, w in items], 8)
    texts = []
    for _ in range(300):
        a = rng.randrange(25)
        texts.append(" ".join([rng.choice(words_) for _ in range(rng.randint(0, 9))] + passage[a : a + rng.randint(4, 20)] + [rng.choice(words_) for _ in range(rng.randint(0, 9))]))
    want = brute_decontamination(texts, [(k, " ".join(w)) for k, w in items])
    got = [index.scan(t.encode()) for t in texts]
    assert [(n, int(hit.sum()), sorted(found)) for n, hit, found in got] == want
    assert 0 < sum(bool(w[2]) for w in want) < len(texts)


def test_the_automaton_is_bounded():
    """A worker's memory for a megabyte of benchmark: the bound of PATTERN_BYTES is stated from this ratio."""
    import subprocess
    import sys

    code = """
import random
from linewright.llm.decontaminate import Index
rng = random.Random(1)
vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 11))) for _ in range(30000)]
items = [(str(k), " ".join(rng.choices(vocabulary, k=100)).encode()) for k in range(1400)]
held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
before = held()
index = Index(items, 8)
print((held() - before) / sum(len(t) for _, t in items))
"""
    ratio = float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert ratio < 70


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(None, "x y", 5), (1, None, 6), (1, None, 6)], "doc_id long, text string, N_HIT int")
    got = decontaminate.decontaminate(docs, bench)
    assert sorted(c.lower() for c in got.columns) == sorted(["doc_id", "text", "n_words", "n_hit", "item_ids", "hit_spans", "contaminated"])
    assert [r["n_hit"] for r in got.collect()] == [0, 0, 0]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    item = spark.createDataFrame([(1, "A b c")], "item_id long, text string")
    cut = decontaminate.decontaminate(frame(spark, ["Zé, a b! c d", None, "x"]), item, width=3, excise=True)
    assert [r["text"] for r in cut.orderBy("doc_id").collect()] == ["Zé,  d", None, "x"]


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(2)
    weights = dict(pii.train())
    for n in range(8000):
        text = "".join(rng.choice("ab@@..-+ (1234567890%é\n") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == plain_spans(text), text
        if n % 10 == 0:
            base, every = pii.find(text, weights)
            assert base == plain_spans(text) and set(base) <= set(every)
    for number in ("4111 1111 1111 1111", "4111-1111-1111-1112", "x4111111111111111y"):
        assert pii.base_spans(number) == plain_spans(number)


def test_the_field_finds_held_out_spans():
    weights, tp, fp, fn = dict(pii.train()), 0, 0, 0
    for text, spans in pii.examples(300, 991):
        found = set(pii.find(text, weights)[1])
        tp, fp, fn = tp + len(found & set(spans)), fp + len(found - set(spans)), fn + len(set(spans) - found)
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.97


def test_decoding_is_the_best_of_all_segmentations():
    weights = dict(pii.train())
    for text, _ in pii.examples(25, 5):
        borders, arcs = pii.lattice(text, 0, len(text))

        def best(j, memo):
            if j == 0:
                return {"none": 0.0}
            if j not in memo:
                scores = {"none": max(best(j - 1, memo).values())}
                for i, kind, names in arcs.get(j, ()):
                    for y, s in best(i, memo).items():
                        t = s + sum(weights.get(n, 0) for n in names) + (weights.get(f"{y}>{kind}", 0) if y != "none" else 0)
                        scores[kind] = max(scores.get(kind, -1e9), t)
                memo[j] = scores
            return memo[j]

        top, place, total, before, end = max(best(len(borders) - 1, {}).values()), {p: k for k, p in enumerate(borders)}, 0.0, "none", 0
        for kind, a, b in pii.decode(text, 0, len(text), weights):
            names = next(n for i, k, n in arcs[place[b]] if i == place[a] and k == kind)
            total += sum(weights.get(n, 0) for n in names) + (weights.get(f"{before}>{kind}", 0) if before != "none" and a == end else 0)
            before, end = kind, b
        assert total == pytest.approx(top)


def dense_list(rng, n, ends):
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    makers = (
        lambda: f"({num(3)}) {num(3)}-{num(4)}",
        lambda: f"{num(3)}-{num(3)}-{num(4)}",
        lambda: " ".join(num(4) for _ in range(4)),
        lambda: f"ann{num(2)} (at) mail{num(1)} (dot) org",
        lambda: num(rng.randint(1, 20)),
    )
    return "".join(rng.choice(makers)() + rng.choice(ends) for _ in range(n))


@pytest.mark.parametrize("ends", ["\n", " ", (" ", ", ", "-", " . ")])
def test_dense_lists_are_one_window(ends):
    weights, rng = dict(pii.train()), random.Random(12)
    phones = "".join(f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}{ends[0]}" for _ in range(1500))
    for text in (phones, dense_list(rng, 1200, ends)):
        assert len(text) > 16_000
        whole = pii.decode(text, 0, len(text), weights, step=len(text))
        base, every = pii.find(text, weights)
        assert set(every) - set(base) == {x for x in whole if not any(x[1] < b and a < x[2] for _, a, b in base)}
        assert pii.decode(text, 0, len(text), weights) == pii.decode(text, 0, len(text), weights, step=37) == pii.decode(text, 0, len(text), weights, step=1) == whole
    if ends == "\n":
        assert [x[1:] for x in pii.find(phones, weights)[1]] == [m.span() for m in re.finditer(".+", phones)]


def test_windows_cut_no_candidate():
    weights, rng = dict(pii.train()), random.Random(13)
    pieces = ["a" * 70, "b1." * 40, "@", " (at) ", "[at]", " (dot) ", ".", " ", "\n", "x", "12", "3", "555-1234", "(212) ", "+44", ", ", "é", "word " * 30, "w" * 130]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))
        parts = pii.windows(text)
        assert all(a < b for a, b in parts) and all(x[1] < y[0] for x, y in zip(parts, parts[1:], strict=False))
        found = lambda a, b: {(borders[i], borders[j], kind) for borders, arcs in [pii.lattice(text, a, b)] for j, own in arcs.items() for i, kind, _ in own}
        assert set().union(*(found(a, b) for a, b in parts)) == found(0, len(text))
        assert [x for a, b in parts for x in pii.decode(text, a, b, weights)] == pii.decode(text, 0, len(text), weights)


def test_pii_frames(spark):
    texts = ["a é b.c@d.org!", None, "", "call (212) 555-1234 now", "1" * 50_000, "x " * 50_000 + "+44 20 7946 0958", "1.2.3.4 1.2.3.4"]
    docs = frame(spark, texts).withColumn("Base_Spans", F.lit(1))
    got = pii.find_pii(docs, redact=True).orderBy("doc_id").collect()
    assert [r["text"] for r in got][:4] == ["a é <EMAIL>!", None, "", "call <PHONE> now"]
    assert got[5]["text"].endswith("x <PHONE>") and got[6]["text"] == "<IP> <IP>"
    assert [len(r["base_spans"]) for r in got] == [1, 0, 0, 0, 0, 1, 2]
    assert pii.find_pii(docs.limit(0)).count() == 0


# Licenses


def brute_license(text):
    """(n_words, places of phrases, labels, score) from every run of lines and every word."""
    w, lines = words(text), [words(x) for x in (text or "").split("\n")]
    places = sorted((k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    labels, score = {x[1] for x in places}, 1.0 if places else 0.0
    for label, t, share in licenses.TEMPLATES:
        tokens = set(t.split())
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if not lines[j] or sum(map(len, lines[i + 1 : j])) > len(t.split()):
                    break
                held = len(tokens & set(sum(lines[i : j + 1], [])))
                if held >= share * len(tokens) - 1e-9:
                    labels.add(label)
                    score = max(score, held / len(tokens))
    return len(w), places, ",".join(sorted(labels)), score


@pytest.mark.parametrize("seed", [8, 18])
def test_licenses_are_brute_force(spark, seed):
    rng = random.Random(seed)
    notices = [t.split() for _, t, *_ in licenses.PHRASES + licenses.TEMPLATES]
    pool = sorted({w for t in notices for w in t}) + ["zu", "é", "xx"]
    texts = []
    for _ in range(90):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = list(rng.choice(notices))
            for _ in range(rng.randint(0, 3)):
                change = rng.randrange(3)
                if change == 0:
                    w[rng.randrange(len(w))] = rng.choice(pool)
                elif change == 1:
                    w.insert(rng.randrange(len(w)), rng.choice(pool))
                elif len(w) > 1:
                    w.pop(rng.randrange(len(w)))
            ends = rng.choice(((" ",), (" ", " ", ", ", "\n"), (" ", "\n * ", "\r\n")))
            parts.append("".join((x.upper() if rng.random() < 0.3 else x) + rng.choice(ends) for x in w))
        texts.append(rng.choice(("\n", ". ", " \n ", "\n\n", "\n \n", "zu " * 9 + "\n")).join(parts))
    texts += [None, "", "\n\n", "cc by nc cc by nc", "under\nthe MIT License", "cc by Kc İ", "x" * 100_000, "under the mit license " * 3000, "of the\n" * 2000]
    got = licenses.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        n, places, labels, score = brute_license(text)
        assert (r["n_words"], r["labels"], r["n_base"]) == (n, labels, len(places)), text
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x[1] for x in places}))
        assert r["score"] == pytest.approx(score)
        assert {m["label"] for m in r["matches"]} == set(labels.split(",")) - {""}


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided that the following conditions are met:\r\n *",
    "gpl": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or",
    "mpl-2": "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this",
    "isc": "// Permission to use, copy, modify, and/or distribute this software for any\n// purpose with or without fee is hereby granted, provided that",
}


def test_wrapped_notices(spark):
    parted = WRAPPED["mit"].replace("\n", "\n\n")
    far = "Released under\n" + "x " * 6 + "\nthe MIT License"
    texts = [f"x\n\nint main\n{t}\n\ny" for t in WRAPPED.values()] + [parted, far, "Released\nunder\nthe\nMIT\nLicense", "Released under\nthe MIT License\nnone", "a\n\nb", "licensed under\nCC BY-NC 4.0"]
    got = licenses.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["mit", "bsd", "gpl,gpl-2", "mpl-2", "isc", "", "", "mit", "mit", "", "cc-by-nc"]
    assert all(r["score"] >= 0.8 for r in got[:5]) and got[0]["score"] == got[1]["score"] == 1
    assert [(w["line"], w["last_line"]) for w in got[0]["matches"]] == [(3, 4)] and [(w["line"], w["last_line"]) for w in got[8]["matches"] if w["line"] is not None] == [(0, 1)]


def test_license_rows(spark):
    docs = spark.createDataFrame([(None, "Released under the MIT License."), (7, "cc by nc"), (7, "cc by nc"), (7, "other")], "doc_id long, text string")
    got = licenses.scan_licenses(docs.withColumn("labels", F.lit(1)).withColumn("h", F.lit(1)))
    assert sorted((r["doc_id"] or 0, r["n_base"], r["labels"]) for r in got.collect()) == [(0, 1, "mit"), (7, 0, ""), (7, 1, "cc-by-nc"), (7, 1, "cc-by-nc")]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.label_documents(docs.where("doc_id is null").withColumn("score", F.lit("x"))).columns.count("score") == 1


# Toxicity


def test_toxicity_learns_held_out_labels(spark):
    rng = random.Random(3)
    syllables = ["ta", "lo", "ri", "mek", "sun", "pel", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for _ in range(900):
        bad = rng.random() < 0.3
        w = [word() for _ in range(rng.randint(20, 60))]
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(("vilegrub", "Nastoid")))
        texts.append(" ".join(w))
        labels.append(int(bad))
    docs = frame(spark, [*texts, None, "", "vilegrub " * 20_000])
    marks = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [k for k in range(900) if got[k]["held_out"]]
    assert 150 < len(held) < 300
    assert np.mean([got[k]["predicted"] == labels[k] for k in held]) > 0.97
    assert got[900]["score"] == got[901]["score"] and got[902]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_edges(spark):
    docs = frame(spark, ["a", "b"])
    for rows in ([], [(0, 1)], [(0, 0), (1, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        got = toxicity.score_toxicity(docs.withColumn("Score", F.lit("x")).unionByName(frame(spark, []).withColumn("Score", F.lit("y"))), model)
        assert got.count() == 2 and all(0 <= r["score"] <= 1 for r in got.collect())
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def naive_model(texts, labels, features):
    """Log-count ratios of n-grams, one text after the other, and the bucket of each."""
    held = {0: {}, 1: {}}
    for text, y in zip(texts, labels, strict=True):
        for b in naive_buckets(text):
            held[y][b] = held[y].get(b, 0) + 1
    n = {y: sum(1 for x in labels if x == y) for y in (0, 1)}
    ratio = {b: np.log((held[1].get(b, 0) + 1) / (n[1] + 2)) - np.log((held[0].get(b, 0) + 1) / (n[0] + 2)) for b in held[0] | held[1]}
    gain = {b: abs(r) * np.sqrt(held[0].get(b, 0) + held[1].get(b, 0)) for b, r in ratio.items() if held[0].get(b, 0) + held[1].get(b, 0) >= 5}
    return ratio, sorted((-g, b) for b, g in gain.items() if g)[:features]


def naive_buckets(text):
    line = " " + " ".join(re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+".decode("latin-1"), text.decode("latin-1").translate(LOWER))) + " "
    raw, out = line.encode("latin-1"), set()
    for n in toxicity.SIZES:
        for k in range(len(raw) - n + 1):
            number = int.from_bytes(raw[k : k + n], "big")
            out.add(((number * 0x9E3779B97F4A7C15) % (1 << 64) ^ (n << 60)) >> (64 - toxicity.BITS))
    return out


def test_scores_are_naive_sums():
    rng = random.Random(31)
    words_ = ["Vile", "grub", "nice", "tea", "é", "day,", "x1", "(so)", "mud"]
    texts = [" ".join(rng.choice(words_) for _ in range(rng.randint(0, 25))).encode() for _ in range(160)]
    labels = np.array([int(b"Vile" in t and b"mud" in t) for t in texts])
    model = toxicity.fit(texts, labels, features=10_000)
    ratio, top = naive_model(texts, labels.tolist(), 10_000)
    assert set(np.flatnonzero(model.weights)) <= {b for _, b in top}
    # The learnt weight of a bucket is its factor times its ratio: zero where the ratio says nothing.
    assert all(abs(ratio[b]) > 0 for b in np.flatnonzero(model.weights).tolist())
    long = b" ".join(texts) * 3
    for text, score in zip([*texts, b"", long], model.score([*texts, b"", long]), strict=True):
        z = model.bias + sum(float(model.weights[b]) for b in naive_buckets(text))
        assert score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)
    assert np.mean((model.score(texts) >= 0.5) == (labels == 1)) > 0.95


def test_training_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows = [(k % 10, ("bad word " if k % 2 else "good word ") * 50) for k in range(400)] + [(None, "x"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(10)] * 3, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: seen.append((texts, labels.tolist())))
    kept = sorted(r[0] for r in spark.range(10).where(~toxicity.held_out(F.col("id"))).collect())
    toxicity.train(docs, marks)
    assert seen[-1] == ([("" if k == 3 else ("bad word " if k % 2 else "good word ") * 50).encode() for k in kept], [k % 2 for k in kept])
    toxicity.train(docs, marks, max_rows=3)
    assert len(seen[-1][0]) == 3
    toxicity.train(docs, marks, max_bytes=1200)
    assert 0 < sum(map(len, seen[-1][0])) <= 1200 and len(seen[-1][0]) < len(kept)
    toxicity.train(docs, marks, max_bytes=0)
    assert sum(map(len, seen[-1][0])) == 0


def test_repeated_documents_are_all_scored(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a")], "doc_id long, text string").withColumn("HELD_OUT", F.lit(7))
    got = toxicity.score_toxicity(docs, toxicity.fit([b"a", b"b"] * 5, np.array([0, 1] * 5)))
    assert got.count() == 4 and [r["held_out"] for r in got.where("doc_id is null").collect()] == [False]
    assert [c.lower() for c in got.columns].count("held_out") == 1


def test_presence_counts_once():
    texts = [b"bad thing here", b"good thing here"] * 20
    model = toxicity.fit(texts, np.array([1, 0] * 20))
    one, many = model.score([b"bad thing here", b"bad thing here " * 1000])
    assert one > 0.5 and many == pytest.approx(one, abs=0.2)


# HTML


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("a &amp; b&nbsp;c &lt;d&gt;", "a & b\xa0c <d>"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("<h1>T</h1>text<br>next", "T\n\ntext\nnext"),
        ("x <b>bold</b> <i> y</i>z", "x bold yz"),
        ("<script>var a='</p>';</script>v<style>p{}</style><!-- c --><!-- > -->w", "vw"),
        ("<html><head><title>t</title><meta><body>b", "b"),
        ("<p hidden>no</p><p style='color:red; display : none'>no</p><span style=\"visibility:hidden\">no</span><template>no</template><noscript>no</noscript>yes", "yes"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n\n  - c\n\nd"),
        ("<ol start=3><li>a</li><li value=7>b</li><li>c</li></ol>", "3. a\n7. b\n8. c"),
        ("<pre>a\n  b\n\nc</pre>d", "a\n  b\n\nc\n\nd"),
        ("<table><tr><th>k<th>value<tr><td>long key<td>1</table>", "k         value\nlong key  1"),
        ("<table><caption>C</caption><tr><td colspan=2>ab<td>c</tr><tr><td>1<td>2<td>3</table>", "C\nab     c\n1   2  3"),
        ("<table><td>a<td>b</table>", "a  b"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
        ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
        ("<details><summary>s</summary>in</details><details open>out</details>", "s\nout"),
        ("<img alt='pic'> <input value=x><textarea>t</textarea>", "pic t"),
        ("a < b and c > d", "a < b and c > d"),
        ("a<3 b<!-->c<!---->d<!DOCTYPE x>e<?php f ?>g</ h>i", "a<3 bcdegi"),
        ("a<!-- b <p>c", "a"),
        ("a<p title='b>c", "a"),
        ("<b>un<i>closed</b>x</i>y", "unclosedxy"),
        ("<a title='>' href=\"<\">link</a>", "link"),
    ],
)
def test_rendering(html, want):
    assert htmltext.render(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<a title=it's>one</a><p>two</p>", "one\n\ntwo"),
        ('<a class="x"">one</a><p>two</p>', "one\n\ntwo"),
        ("a<b don't</p><p>two</p>it's", "a\n\ntwo\n\nit's"),
        ("<a title=it's>one</a><p title='x'>two", "one\n\ntwo"),
        ("<a b=c\">one</a \"><i '>two</i ='>three", "onetwothree"),
        ("<a b=>one</a><a b = '>'>two</a><a ='>three", "onetwothree"),
        ("<a/b='>'/>one<a b/='>two", "onetwo"),
        ("<a x\"hidden>one</a><a it's hidden>no</a><a b=\"1\"hidden>no</a><a hidden=>no</a>", "one"),
        ("<img it's alt=pic><img alt = \"it's\"><img alt=it's>", "picit'sit's"),
        ("one<p a='>two", "one"),
        ("one<p a=\"'>two", "one"),
    ],
)
def test_stray_quotes_end_no_page(html, want):
    assert htmltext.render(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div>" * 420 + "<div style='display:none'>secret</div>" + "</div>" * 420 + "end", "end"),
        ("<ul><li>" * 3 + "x", "- - - x"),
        ("<table><tr><td colspan=60>a<td>b<tr><td>c<td>d</table>", "a     b\nc  d"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D</table>", "A  B\n   C\n   D"),
        ("<table><tr><td rowspan=2 colspan=2>A<td>B<tr><td>C<tr><td>1<td>2<td>3</table>", "A     B\n      C\n1  2  3"),
        ("<style>.h{display:none}#i , b{visibility:hidden}</style><p class='x h'>no</p><i id=i>no<u style='visibility:visible'>yes</u></i><b>no</b>", "yes"),
        ("<style>p{display:none}.s{display:block}p.t{display:none!important}</style><p>no<p class=s>yes<p class='s t'>no<p class=s style='display:none'>no", "yes"),
        ("<style>@media print{p{display:none}}@media screen{i{display:none}}/* b{display:none} */div p{display:none}u:hover{display:none}</style><p>a</p><i>no</i><b>b</b><u>c</u>", "a\n\nbc"),
        ("<style media=print>p{display:none}</style><p>yes</p><style>@import 'x';p{color:red}", "yes"),
        ("<div hidden style='display:block'>yes</div><div hidden>no</div>", "yes"),
        ("<html><head><title>t</title><p>one</p><div>two", "one\n\ntwo"),
        ("<head><meta a=b> words <b>here", "words here"),
        ("a</br>b", "a\nb"),
        ("x<select><option>one<option selected>two</select>y <select multiple><option>p<option>q</select>", "x two y p q"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<math><mi>x</mi><mo>=</mo><annotation>no</annotation></math> <svg><title>no</title><text>in <tspan>svg</tspan></text>no<g>no</g></svg>", "x= in svg"),
        ("<ol type=a start=26><li>z<li>aa</ol><ol type=I reversed><li>two<li>one</ol>", "z. z\naa. aa\n\nII. two\nI. one"),
        ("<ul><li><p>a</p><p>b</p><li></ul>", "- a\n\n  b\n-"),
        ("<p>a</p><ul><li><br><li><pre>\n  x\n</pre></ul>b", "a\n\n-\n-   x\n\nb"),
    ],
)
def test_visibility_and_layout(html, want):
    assert htmltext.render(html) == want


def slow_parts(nodes):
    """Lines and gaps (None) of a tree of (name, children) and words; a list, quote or table is made whole on its own."""
    out = []
    for node in nodes:
        if isinstance(node, str):
            out.append(node)
            continue
        name, children = node
        gap = [None] * (name in ("p", "ul", "ol", "table", "blockquote", "h2"))
        if name in ("ul", "ol"):
            lines = []
            for k, (_, item) in enumerate(children, 1):
                mark, own = "- " if name == "ul" else f"{k}. ", slow_lines(item)
                lines += [(mark + x if j == 0 else " " * len(mark) + x) if x else x for j, x in enumerate(own)] or [mark.rstrip()]
        elif name == "table":
            rows = [[slow_lines(cell) or [""] for _, cell in row] for _, row in children]
            wide = {k: max(len(x) for r in rows if k < len(r) for x in r[k]) for k in range(max(map(len, rows), default=0))}
            lines = [x for r in rows if any(map(any, r)) for j in range(max(map(len, r))) for x in ["  ".join((c[j] if j < len(c) else "").ljust(wide[k]) for k, c in enumerate(r)).rstrip()]]
        elif name == "blockquote":
            lines = ["  " + x if x else x for x in slow_lines(children)]
        else:
            lines = slow_parts(children)
        out += [*gap, *lines, *gap]
    return out


def slow_lines(nodes):
    """The same, a gap between two lines as one blank line."""
    out, gap = [], False
    for part in slow_parts(nodes):
        if part is None:
            gap = True
        elif part or out:
            out += [""] * (gap and bool(out)) + [part]
            gap = False
    while out and not out[-1]:
        out.pop()
    return out


def random_tree(rng, depth, inside=""):
    nodes, n = [], 0
    for _ in range(rng.randint(0, 4)):
        name = rng.choice(["", "div", "p", "h2", "ul", "ol", "table", "blockquote", "section"])
        if not name or depth == 0 or (inside in ("p", "h2") and name):
            if not nodes or not isinstance(nodes[-1], str):
                nodes.append(f"word{rng.randrange(99)} é{n}")
        elif name in ("ul", "ol"):
            nodes.append((name, [("li", random_tree(rng, depth - 1)) for _ in range(rng.randint(0, 3))]))
        elif name == "table":
            nodes.append((name, [("tr", [("td", random_tree(rng, depth - 1)) for _ in range(rng.randint(0, 3))]) for _ in range(rng.randint(0, 3))]))
        else:
            nodes.append((name, random_tree(rng, depth - 1, name)))
        n += 1
    return nodes


def written(rng, nodes):
    """HTML of a tree, with end tags left out at random where a browser puts them in."""
    out = []
    for k, node in enumerate(nodes):
        if isinstance(node, str):
            out.append(rng.choice(("", " ", "\n")) + node.replace(" ", rng.choice((" ", "\n ", "<b> </b>"))) + rng.choice(("", " ", "<!-- c -->", "<i hidden>no</i>", "<script>no</script>")))
            continue
        name, children = node
        after = nodes[k + 1] if k + 1 < len(nodes) else None
        may = name in ("li", "td", "tr") or (name == "p" and after is not None and not isinstance(after, str) and after[0] != "table")
        gap = rng.choice(("", "\n"))
        out.append(f"<{name}{rng.choice(('', ' a=b', ' class=x'))}>{gap}{written(rng, children)}" + ("" if may and rng.random() < 0.5 else f"</{name}>"))
    return "".join(out)


def test_layout_is_that_of_a_slow_renderer():
    rng = random.Random(77)
    for _ in range(1500):
        tree = random_tree(rng, rng.randint(1, 4))
        html = written(rng, tree)
        assert htmltext.render(html) == "\n".join(slow_lines(tree)), html


def test_stray_quotes_take_linear_time():
    import time

    began = time.process_time()
    for part in ("<a it's>", '<a b="c"">', "<a '", "<a b='c", "<a b = ", "<a =", "<a b/=", "a " * 5):
        htmltext.render(part * 20_000)
        htmltext.render("<a " + part * 20_000)
    assert time.process_time() - began < 20


def test_odd_pages_take_linear_time():
    import time

    began = time.process_time()
    for part in ('<a "', "<", "<div>", "<p>", "<!--", "&", "<a b=c", "<table><tr>", "</p", "<![x", "<p><b>", "<td><i></b>", "<ul><li>x", "<select><option>", "<style>a{}"):
        htmltext.render(part * 20_000)
    assert time.process_time() - began < 20


def test_everything_visible_is_emitted():
    for name in ("div", "span", "ul><li", "table><tr><td", "blockquote", "b"):
        assert htmltext.render(f"<{name}>" * 20_000 + "deep" + "</div>" * 20_000 + "end").replace("-", " ").split()[0].startswith("deep")
    rng = random.Random(6)
    tags = ["p", "div", "ul", "li", "table", "tr", "td", "b", "ol", "pre", "dl", "dt", "h2", "a", "blockquote", "tbody", "th", "caption", "section"]
    for _ in range(400):
        tokens, parts = [], []
        for k in range(rng.randint(1, 25)):
            parts.append(rng.choice(("<{}>", "</{}>")).format(rng.choice(tags)))
            if rng.random() < 0.6:
                tokens.append(f"w{k}")
                parts.append(f"w{k} ")
        text = htmltext.render("".join(parts))
        assert sorted(re.findall(r"w\d+", text)) == sorted(tokens), "".join(parts)


def test_html_frames(spark):
    pages = spark.createDataFrame([(1, "<p>x", 1), (None, None, 2), (1, "<p>x", 1)], "page_id long, html string, TEXT int")
    assert sorted(r["text"] for r in htmltext.extract_text(pages).collect()) == ["", "x", "x"]
    assert htmltext.extract_text(pages.limit(0)).count() == 0


# URL rules


def brute_url(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [(len(r), len(r.partition("/")[0]), v == "block", r, v) for v, r in rules if host and ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("limit", [100_000, 0])
def test_url_rules_are_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(urlfilter, "BROADCAST_RULES", limit)
    rng = random.Random(9)
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "a.org/x"), ("allow", "org/abc"), ("block", "b.com/"), ("allow", "b.com/")]
    urls = ["".join((rng.choice(("http://", "HTTPS://", "", "x://")), rng.choice(("", "a.", "www.", "B.")), rng.choice(("example.org", "org", "b.com", "EXAMPLE.com", "", "xorg", "x..org")), rng.choice(("", "/", "/es/", "/en/1", "/en/12/", "/fr/x", "/de/", "/abc", "/x", "/é://")), rng.choice(("", "?a=/es/", "#/es/", "/b?c#d")))) for _ in range(400)] + [None, "", "://", "a://b\nc.org/x"]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id long, url string, Rule string")
    got = urlfilter.filter_urls(pages, urlfilter.rule_table(spark, rules)).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [brute_url(u, rules) for u in urls]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_digests_confirm_what_prefixes_join(spark, monkeypatch, limit):
    """With prefixes that all rules share, and without broadcasts, the answers stay; a hot host, no host and long URLs too."""
    monkeypatch.setattr(urlfilter, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(urlfilter, "_short", lambda digest: F.substring(digest, 1, 0))
    rules = [("block", "a.org/x"), ("allow", "org/"), ("block", "b.com/y/z"), ("allow", "a.org/xy")]
    urls = ["http://a.org/xyz", "http://www.a.org/x", "http://org", "http://b.com/y/z?q", "http://b.com/y"] * 30 + [None] * 200 + ["http://" + "s." * 2000 + "a.org/x" + "p" * 50_000]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(limit or -1))
    try:
        out = urlfilter.filter_urls(pages, urlfilter.rule_table(spark, rules))
        assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in out.orderBy("page_id").collect()] == [brute_url(u, rules) for u in urls]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("Exchange hashpartitioning" in plan) is (limit == 0)


def test_url_edges(spark):
    pages = spark.createDataFrame([(None, "http://a.org/"), (1, None), (1, None)], "page_id long, url string")
    none = urlfilter.rule_table(spark, [("allow", "x/")]).limit(0)
    assert [r["verdict"] for r in urlfilter.filter_urls(pages, none).collect()] == ["allow"] * 3
    assert urlfilter.filter_urls(pages.limit(0), urlfilter.rule_table(spark, [("block", "org/")])).count() == 0
    assert hashlib.sha256(b"org/").digest()[:4] == bytes(spark.range(1).select(F.substring(urlfilter._digest(F.lit("org"), F.lit("/")), 1, 4)).first()[0])
