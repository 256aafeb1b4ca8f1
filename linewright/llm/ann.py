"""Exact nearest neighbours by a block matrix join on int8 tiles.

Queries and candidates are dealt into blocks. A tile (one query block, one candidate block) takes
int8 dot products of scaled vectors; with the norms of the quantisation residues they bound every
distance from both sides. Candidates whose lower bound exceeds the k-th smallest upper bound are
out; the others are recomputed in double precision on the original vectors and the k best of each
query go through a heap. A second step merges the tiles' heaps.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without an id; candidates are compared with queries of the same length only; the
query's own id is no candidate; repeated rows of an id count as one row each; ties go to the
smaller id; fewer than k candidates give all of them; no query gives no row.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linewright.session import ship_package

#: Rows of a block on either side: a tile of 4096 x 8192 bounds takes 256 MB at most, in strips of 64 queries 4 MB.
QUERY_BLOCK, ROW_BLOCK, STRIP = 4096, 8192, 64


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes as float32, the scale of each row and the norm of what rounding left over."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None])
    return codes.astype(np.float32), scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest of the candidates for every query: (query, candidate, distance)."""
    out: list[tuple[int, int, float]] = []
    (qc, qs, qe), (cc, cs, ce) = quantise(q), quantise(c)
    qn, cn = (qc.astype(np.float64) ** 2).sum(1) * qs**2, (cc.astype(np.float64) ** 2).sum(1) * cs**2
    for at in range(0, len(q), STRIP):
        rows = slice(at, at + STRIP)
        # Products of int8 codes: sums stay below 2**24 up to 1040 dimensions, so float32 holds them exactly.
        dots = (qc[rows] @ cc.T if q.shape[1] <= 1040 else qc[rows].astype(np.float64) @ cc.T.astype(np.float64)).astype(np.float64)
        near = np.sqrt(np.maximum(qn[rows, None] + cn[None] - 2 * dots * qs[rows, None] * cs[None], 0))
        slack = (qe[rows, None] + ce[None]) * (1 + 1e-9) + 1e-6 * (np.sqrt(qn[rows, None]) + np.sqrt(cn[None]))
        own = qid[rows, None] == cid[None]
        upper = np.where(own, np.inf, near + slack)
        kth = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, min(k, upper.shape[1]) - 1]
        alive = (near - slack <= kth[:, None]) & ~own
        for i in range(alive.shape[0]):
            who = np.flatnonzero(alive[i])
            best: list[tuple[float, int]] = []
            for part in range(0, len(who), 4096):
                some = who[part : part + 4096]
                diff = c[some] - q[at + i]
                # Summed in the order of the components, as a plain loop would.
                exact = np.sqrt(np.cumsum(diff * diff, axis=1)[:, -1])
                best = heapq.nsmallest(k, chain(best, zip(exact.tolist(), cid[some].tolist(), strict=True)))
            out += [(int(qid[at + i]), int(v), float(d)) for d, v in best]
    return out


def usable(vector: Column) -> Column:
    """Not null, not zero, and every component present and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(rows: DataFrame, query: Column, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of all ``rows`` to each row where ``query`` holds."""
    spark = rows.sparkSession
    ship_package(spark)
    v = rows.where(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), query.alias("is_query")).withColumn("dim", F.size("v"))
    n, n_q = v.agg(F.count("*"), F.count_if("is_query")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n_q:
        return spark.createDataFrame([], schema)
    q_blocks, c_blocks = -(-n_q // QUERY_BLOCK), max(-(-n // ROW_BLOCK), min(n // 1024 + 1, spark.sparkContext.defaultParallelism))
    deal = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # A tile for each pair of blocks: every block is sent once for each block of the other side.
    queries = v.where("is_query").select("dim", deal(q_blocks, 1).alias("qb"), "id", "v").select("*", every(c_blocks).alias("cb"))
    rest = v.select("dim", deal(c_blocks, 2).alias("cb"), "id", "v").select("*", every(q_blocks).alias("qb"))

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        got = tile(left["id"].to_numpy(), np.stack(left["v"].to_numpy()), right["id"].to_numpy(), np.stack(right["v"].to_numpy()), k)
        return pd.DataFrame(got, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ["dim", "qb", "cb"]
    met = queries.groupBy(*keys).cogroup(rest.groupBy(*keys)).applyInPandas(join, "query_id long, vec_id long, score double")
    # The rank limit below is applied before the shuffle too, so each task sends k rows of a query at most.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
