"""A corpus from raw documents to token ids: five stages, each written as Parquet and reread by the next.

Documents that the toxicity classifier rejects go; one document of each group of near duplicates
stays; documents that hold two or more benchmark items go, and what others hold of a single item is
cut out; personal data give way to the name of their kind; what is left is encoded. Every stage but
the last returns the columns of ``documents``, whatever they are called; the last has piece_ids and
n_pieces for text.

Defined results: null and empty texts are not toxic, near duplicates of nothing and clean, and have no
pieces; rows without an id pass every stage that their text passes; of rows that repeat an id one
stays; texts of any length are handled whole; of near duplicates that tie the smallest id stays; an
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import decontaminate, neardup, pii, sentencepiece_trie, toxicity
from linewright.llm.queries import PIECES, table
from linewright.session import materialise


def _kept(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of ``docs``, with the columns of ``docs``: but for id and text they bear names that no operator's column has.

    n_chars, where there is such a column, is as long as the text then is.
    """
    names = docs.columns
    inside = [c if c in ("doc_id", "text") else f"_own_{k}" for k, c in enumerate(names)]
    out = stage(docs.toDF(*inside)).select(*[F.col(a).alias(b) for a, b in zip(inside, names, strict=True)])
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda d: toxicity.score_toxicity(d, model).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, neardup.deduplicate)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark")
    return _kept(docs, lambda d: decontaminate.decontaminate(d, benchmark, excise=True).where("not contaminated"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _kept(docs, lambda d: pii.find_pii(d, redact=True))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepiece_trie.encode(docs, PIECES, columns=[c for c in docs.columns if c not in ("text", "n_pieces")])
    return out.withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("personal data", redact_pii),
    ("SentencePiece encoding", encode_pieces),
]

#: A trained classifier and a tokenizer are no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
