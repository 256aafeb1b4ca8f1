"""URL filtering by host-suffix and path-prefix expressions.

Each URL is expanded into every host suffix joined with every path prefix whose length some rule
has. Rules are kept in buckets by the first 4 bytes of the SHA-256 of their expression; URLs meet
them in an equi-join on these 4 bytes alone, the full digests in the bucket confirm, and the
longest rule wins (ties: the longer host, then block).

The join runs on the distinct pairs of a host and as much of its path as rules can tell apart, so
pages themselves are not shuffled where the pairs that met a rule fit into a broadcast (their bytes
are counted first); where they don't, pages are shuffled by pair and share, those without a host
dealt over all shares.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; a
URL without a rule gets ``default``; repeated rows each get an answer; without rules everything
gets ``default``; an empty table gives no row; a URL of any length is read whole. Input columns
named like an output column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewright.llm.common import ascii_lower, drop_clashing
from linewright.session import materialise

#: Rules up to which their side of the join is broadcast (each row is under 300 bytes); more are shuffled.
BROADCAST_RULES = 100_000
#: Bytes of the pairs with a rule up to which they are broadcast to the pages.
BROADCAST_BYTES = 32 << 20
#: Shares that the pages of one host and path prefix are dealt over where they are shuffled.
SHARES = 16


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, path).cast("binary"), 256))


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 4)


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows (rule_id, verdict, rule, host, path) of (verdict, 'host/path') rules; the higher rule_id wins."""
    rows = sorted(set(rules), key=lambda x: (len(x[1]), len(x[1].partition("/")[0]), x[0] == "block", x[1]))
    table = [(i, v, r, r.partition("/")[0].lower(), "/" + r.partition("/")[2]) for i, (v, r) in enumerate(rows)]
    return spark.createDataFrame(table, "rule_id long, verdict string, rule string, host string, path string")


def buckets(rules: DataFrame) -> DataFrame:
    """(_short, _full): for each 4-byte prefix the (digest, rule_id) of its rules."""
    rules = rules.withColumn("_digest", _digest(F.col("host"), F.col("path")))
    return rules.groupBy(_short(F.col("_digest")).alias("_short")).agg(F.collect_list(F.struct("_digest", "rule_id")).alias("_full"))


def _best_rules(pages: DataFrame, rules: DataFrame, lengths: list[int], broadcast: bool) -> DataFrame:
    """(_h, _p, rule, _verdict) of each distinct (host, path prefix) of ``pages`` that a rule fits."""
    # Rules see no more of a path than the longest rule has, so few keys stand for all URLs of a host.
    keys = pages.where("host != ''").select(F.col("host").alias("_h"), "_p").distinct()
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("_p")), lambda n: F.substring(F.col("_p"), F.lit(1), n))
    spread = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))
    keyed = keys.withColumn("_own", F.explode(spread)).withColumn("_short", _short(F.col("_own")))
    side = lambda df: F.broadcast(df) if broadcast else df
    met = keyed.join(side(buckets(rules)), "_short")
    # Other rules may share the 4 bytes: only an equal digest is a match.
    best = F.array_max(F.transform(F.filter("_full", lambda x: x["_digest"] == F.col("_own")), lambda x: x["rule_id"]))
    top = met.select("_h", "_p", best.alias("_best")).where("_best is not null").groupBy("_h", "_p").agg(F.max("_best").alias("_best"))
    names = rules.select(F.col("rule_id").alias("_best"), "rule", F.col("verdict").alias("_verdict"))
    return top.join(side(names), "_best").drop("_best")


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules`` are rows of :func:`rule_table`."""
    known = rules.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    base = drop_clashing(pages, ["host", "path", "rule", "verdict"]).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not known["n"]:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    own = base.columns
    base = base.withColumn("_p", F.substring("path", 1, max(known["lengths"])))
    best = materialise(_best_rules(base, rules, known["lengths"], known["n"] <= BROADCAST_RULES), "url-rules")
    size = best.agg(F.sum(F.octet_length("_h") + F.octet_length("_p") + F.octet_length("rule") + 100)).first()[0] or 0
    fits = (F.col("host") == F.col("_h")) & (base["_p"] == best["_p"])
    if size <= BROADCAST_BYTES:
        best = F.broadcast(best)
    else:
        # A hot host is one key, and so is having none: pages are dealt over shares by all their plain columns.
        plain = [f.name for f in pages.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
        base = base.withColumn("_share", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(SHARES)).cast("int"))
        best = best.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        fits = fits & (F.col("_share") == F.col("_of"))
    return base.join(best, fits, "left").select(*own, "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))
