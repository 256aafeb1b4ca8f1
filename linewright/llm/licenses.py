"""License scans by an exact set-similarity join, in DataFrame operations only.

Blocks are runs of lines (for templates; a single line is one, too) and whole documents (for phrases).
A run is adjacent lines, none without a word, of which the inner ones hold together at most as many
words as the template: so a notice is found however it is wrapped. A template is a token set with a
threshold; a block meets it if it holds at least that share of its tokens (a phrase: all, standing
consecutively). Tokens of all templates are ordered by how many lines hold them, rarest first:

* prefix filter: a block can meet a template of n tokens, of which it must hold m, only if it holds
  one of the first n - m + 1 of them; the equi-join runs on those tokens;
* length filter: it must hold at least m tokens of the templates' vocabulary;
* positional filter: when the first shared token stands at place i of the template and j of the
  block, at most min(n - i, size - j) tokens can be shared;

and the survivors' full overlaps are counted. For runs of several lines the filters look at a
document's lines taken together, which hold all that any of its runs holds; one pass over the lines of
what they leave finds the longest run that ends at each line. The filters only drop pairs that cannot
meet the threshold, so the result is exact.

Defined results: null or empty texts have no words, no places and no labels, and score 0; repeated
rows each get their answer; rows without an id get theirs too; a text of any length is read whole;
ties in frequency are ordered by the token itself, which changes no result; an empty table gives no
row. Input columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.common import drop_clashing
from linewright.session import materialise

# Phrases and their labels, then the notices that licenses ask to be put into files.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: (label, notice, share of its tokens): short notices that differ from others by a word need all.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.8),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.8),
    ("mit", "released under the mit license", 1.0),
    ("apache-2", "licensed under the apache license version 2 0", 1.0),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.8),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", 0.8),
    ("gpl", "licensed under the gnu general public license", 1.0),
    ("gpl-2", "the gnu general public license version 2", 1.0),
    ("gpl-3", "the gnu general public license version 3", 1.0),
    ("lgpl", "the gnu lesser general public license", 1.0),
    ("agpl", "the gnu affero general public license", 1.0),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.8),
    ("epl", "made available under the terms of the eclipse public license", 1.0),
    ("boost", "distributed under the boost software license version 1 0", 1.0),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", 0.8),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.8),
    ("cc0", "has waived all copyright and related or neighboring rights to this work", 0.8),
    ("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
    ("cc-by-sa", "licensed under cc by sa 4 0", 1.0),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license", 0.8),
]

_GAPS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def normalise(text: Column) -> Column:
    """A-Z lower-cased, gaps between words as single spaces, line feeds kept.

    ``lower`` is the fast way; the two characters that it would turn into ASCII letters are put out of its way.
    """
    safe = F.replace(F.replace(text, F.lit("K"), F.lit("ø")), F.lit("İ"), F.lit("ø"))
    return F.regexp_replace(F.lower(safe), _GAPS, " ")


def _words(line: Column) -> Column:
    line = F.trim(line)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " "))


def _table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    cell = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[cell(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


def _best_run(lines: Column, sizes: Column, words: Column, n: Column) -> Column:
    """(shared, line, last_line) of the run that shares most of a template's ``words`` (``n`` with repeats), then the first; both lines negative.

    A step holds the lines with shared words of the longest run that ends at its line: (line, words up to its end, shared).
    """
    cells = F.zip_with(lines, sizes, lambda b, size: F.struct(F.array_intersect(b, words).alias("b"), size.alias("n")))
    none = F.array().cast("array<struct<line:int,until:int,b:array<string>>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("until"), none.alias("held"), F.struct(F.lit(0).alias("shared"), F.lit(0).alias("line"), F.lit(0).alias("last_line")).alias("best"))

    def better(run: Column) -> Column:
        held = run["held"]
        lines_of = lambda k: -F.coalesce(F.try_element_at(held, F.lit(k))["line"], F.lit(0))
        own = F.struct(F.size(F.array_distinct(F.flatten(F.transform(held, lambda x: x["b"])))).alias("shared"), lines_of(1).alias("line"), lines_of(-1).alias("last_line"))
        return F.greatest(run["best"], own)

    def step(run: Column, cell: Column) -> Column:
        kept = F.filter(run["held"], lambda x: run["until"] - x["until"] <= n)
        own = F.struct(run["at"].alias("line"), (run["until"] + cell["n"]).alias("until"), cell["b"].alias("b"))
        held = F.when(cell["n"] == 0, none).when(F.size(cell["b"]) == 0, kept).otherwise(F.concat(kept, F.array(own)))
        return F.struct((run["at"] + 1).alias("at"), (run["until"] + cell["n"]).alias("until"), held.alias("held"), better(run).alias("best"))

    return F.aggregate(cells, start, step, better)


def needed(notice: str, share: float) -> int:
    """How many of a notice's tokens a block must hold."""
    return math.ceil(round(share * len(set(notice.split())), 9))


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str, float]] = TEMPLATES) -> DataFrame:
    """One row for each document: its id and n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    matches: array of (label, line, last_line, containment): the lines that meet a template, and where runs of
    several lines hold more of one the best of them, then the first; lines are null for a phrase.
    Documents are read once; only matches and a narrow row for each document are shuffled.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for _, t, *_ in [*phrases, *templates] for w in t.split()})
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).select("doc_id", F.xxhash64("t").alias("h"), F.coalesce(normalise(F.col("t")), F.lit("")).alias("norm"))
    # A gap beside a line feed leaves one space, which _words trims.
    by_line = F.transform(F.split("norm", "\n"), lambda l: F.array_intersect(_words(l), _strings(vocabulary)))
    # The generator keeps by_line from being computed once for each of its uses.
    read = base.select("doc_id", "h", "norm", F.explode(F.array(by_line)).alias("lines")).withColumn("b", F.array_distinct(F.flatten("lines")))
    whole_phrase = [F.size(F.array_intersect("b", _strings(sorted(set(p.split()))))) == len(set(p.split())) for _, p in phrases]
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace("norm", r"[ \n]+", " ")), F.lit(" "))
    sizes = F.transform(F.split("norm", "\n"), lambda l: F.when(F.trim(l) == "", F.lit(0)).otherwise(_spaces(F.trim(l)) + 1))
    # Documents are read here and only here: what goes on is their words of the vocabulary, line by
    # line, and the text of those that hold all words of a phrase.
    read = materialise(read.select("doc_id", "h", sizes.alias("sizes"), "lines", F.when(reduce(lambda x, y: x | y, whole_phrase), flat).alias("flat")), "license-words")
    lines = read.select("doc_id", "h", F.posexplode("lines").alias("line", "b"))
    counts = {r["w"]: r["n"] for r in lines.select(F.explode("b").alias("w")).groupBy("w").agg(F.count("*").alias("n")).toLocalIterator()}
    ranks = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rank_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, ranks[w])])

    rows, prefixes = [], []
    for k, (label, notice, share, phrase) in enumerate([(a, b, 1.0, True) for a, b in phrases] + [(a, b, c, False) for a, b, c in templates]):
        tokens, must = sorted({ranks[w] for w in notice.split()}), needed(notice, share)
        rows.append((k, label, " ".join(notice.split()), phrase, tokens, must))
        prefixes += [(phrase, token, k, i, len(tokens), must) for i, token in enumerate(tokens[: len(tokens) - must + 1])]
    known = F.broadcast(_table(spark, rows, ["k", "label", "notice", "phrase", "tokens", "must"]))
    index = F.broadcast(_table(spark, prefixes, ["phrase", "token", "k", "i", "n", "must_"]))

    def candidates(blocks: DataFrame, phrase: bool) -> DataFrame:
        """Pairs of a block (column b: its ranks, ascending) and a template that pass the three filters."""
        mine = [r for r in rows if r[3] is phrase]
        heads = sorted({p[1] for p in prefixes if p[0] is phrase})
        some = blocks.where((F.size("b") >= min(r[5] for r in mine)) & F.arrays_overlap("b", F.array(*[F.lit(x) for x in heads])))
        met = some.select("*", F.posexplode("b").alias("j", "token")).join(index.where(F.col("phrase") == phrase).drop("phrase"), "token")
        bound = F.least(F.col("n") - F.col("i"), F.size("b") - F.col("j"))
        met = met.where((F.size("b") >= F.col("must_")) & (bound >= F.col("must_")))
        # Of several shared prefix tokens the first pair stands for the block and template.
        tokens = known.select("k", "label", "notice", "tokens", "must")
        met = met.join(tokens, "k").withColumn("shared", F.array_intersect("b", "tokens"))
        return met.where((F.size("shared") >= F.col("must")) & (F.element_at("shared", 1) == F.col("token")))

    as_ranks = lambda b: F.array_sort(F.transform(b, lambda w: rank_of[w]))
    in_lines = candidates(lines.where(F.size("b") > 0).withColumn("b", as_ranks(F.col("b"))), False)
    found = in_lines.select("doc_id", "h", "k", "label", "line", (F.size("shared") / F.size("tokens")).alias("containment"), F.lit(None).cast("long").alias("places"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.col("line").alias("last_line"))
    whole = read.where("flat is not null").select("doc_id", "h", "flat", F.array_distinct(F.flatten("lines")).alias("b"))
    by_doc = candidates(whole.withColumn("b", as_ranks(F.col("b"))), True).withColumn("parts", F.split("flat", F.concat(F.lit(" (?="), F.col("notice"), F.lit(" )")), -1)).where(F.size("parts") > 1)
    places = by_doc.select("doc_id", "h", "k", "label", F.lit(None).cast("int").alias("line"), F.lit(1.0).alias("containment"), (F.size("parts") - 1).cast("long").alias("places"), _spaces(F.element_at("parts", 1)).cast("long").alias("first"), (_spaces(F.col("flat")) - 1 - _spaces(F.element_at("parts", -1))).cast("long").alias("last"), F.lit(None).cast("int").alias("last_line"))
    # The filters run before a row is made for a template: rows with the lines of a whole document are wide.
    by_rank = sorted(ranks, key=ranks.get)
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), F.lit(must).alias("must"), F.lit(len(notice.split())).alias("n"), _strings([by_rank[t] for t in tokens]).alias("words"), _strings([by_rank[t] for t in tokens[: len(tokens) - must + 1]]).alias("head")) for k, label, notice, phrase, tokens, must in rows if not phrase])
    several = read.where(F.size("lines") > 1).select("doc_id", "h", "lines", "sizes", F.explode(F.array(F.array_distinct(F.flatten("lines")))).alias("b")).where(F.size("b") >= min(r[5] for r in rows if not r[3]))
    several = several.withColumn("t", F.explode(F.filter(wanted, lambda t: (F.size("b") >= t["must"]) & F.arrays_overlap("b", t["head"]) & (F.size(F.array_intersect("b", t["words"])) >= t["must"]))))
    # The generator keeps the run from being computed once for each of its uses.
    runs = several.select("doc_id", "h", "t.k", "t.label", "t.must", "t.words", F.explode(F.array(_best_run(F.col("lines"), F.col("sizes"), F.col("t.words"), F.col("t.n")))).alias("run")).where(F.col("run.shared") >= F.col("must"))
    runs = runs.select("doc_id", "h", "k", "label", (-F.col("run.line")).alias("line"), (F.col("run.shared") / F.size("words")).alias("containment"), F.lit(None).cast("long").alias("places"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), (-F.col("run.last_line")).alias("last_line"))
    # A document can be listed under repeated rows: the same block counts once.
    found = found.union(places).union(runs).distinct()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    of = found.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.sum("places").alias("n_base"), F.min("first").alias("first_word"), F.max("last").alias("last_word"), joined(F.when(F.col("places").isNotNull(), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("containment").alias("score"), F.array_sort(F.collect_list(F.struct("label", "line", "last_line", "containment"))).alias("matches"))
    # Written, so that the join below knows its size, and can split the rows of a text or id that many rows share.
    of = materialise(of, "license-matches")
    all_docs = read.select("doc_id", "h", F.aggregate("sizes", F.lit(0).cast("long"), lambda n, l: n + l).alias("n_words"))
    # Texts without a word, nulls among them, have no match: they are no part of the join.
    out = all_docs.where("n_words > 0").join(of, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").drop("_id", "_h", "h")
    bare = all_docs.where("n_words = 0").select("doc_id", "n_words", *[F.lit(None).cast(of.schema[c].dataType).alias(c) for c in of.columns[2:]])
    none = F.array().cast("array<struct<label:string,line:int,last_line:int,containment:double>>")
    return out.unionByName(bare).select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("matches", none).alias("matches"))


def label_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the columns of :func:`scan_licenses`, joined on the id; for tables whose ids are unique."""
    key = options.get("doc_id", "doc_id")
    found = scan_licenses(docs, **options).withColumnRenamed("doc_id", key)
    return drop_clashing(docs, [c for c in found.columns if c != key]).join(found, key, "left")
