"""The registered queries of the ten operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm import ann, decontaminate, htmltext, licenses, neardup, pii, sentencepiece_trie, tokenfile, toxicity, urlfilter

#: Vocabulary files; parameters of the operators.
PIECES, WORD_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
#: (verdict, host/path prefix).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), _digest(F.array_join("item_ids", ",")).alias("items_sha256"), "contaminated")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_trie.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, columns=["doc_id"], outputs=("n_pieces", "ids_crc32", "decoded_ok"))


def sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same traversal with forward sums: the vocabulary's pieces and scores as a unigram model."""
    return sentencepiece_trie.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, kind="unigram", columns=["doc_id"], outputs=("n_pieces", "ids_crc32", "decoded_ok"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=["doc_id"])
    of = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in pii.KINDS]
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", *counts, _digest(joined("base_spans")).alias("base_sha256"), joined("pii_spans").alias("spans"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(table(spark, sf_dir, "pages").select("page_id", "html"), columns=["page_id"])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, columns=["doc_id"]).select("doc_id", "held_out", "score", "predicted")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_BPE)
    return tokenfile.read_token_files(spark, files)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_sentencepiece, sentencepiece_viterbi, op3_near_duplicates, op4_pii, op5_html_text, op6_toxicity, op7_licenses, op8_nearest, op9_token_files, op10_url_rules)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + 7], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 7))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d),
g AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM pos, sizes WHERE i + n - 1 <= len(w)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM g JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP3 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.doc_id WHERE r.root < e.v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""


def _op7() -> str:
    quote = lambda s: "'" + s + "'"
    phrases = ", ".join(f"({quote(a)}, {quote(b)}, {len(b.split())})" for a, b in licenses.PHRASES)
    templates = ", ".join(f"({quote(a)}, [{', '.join(quote(w) for w in sorted(set(b.split())))}], {licenses.needed(b, c)}, {len(b.split())})" for a, b, c in licenses.TEMPLATES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w, list_transform(string_split({_LOWER}, chr(10)), lambda l: regexp_extract_all(l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS ls FROM documents),
ph(label, phrase, n) AS (VALUES {phrases}),
te(label, tokens, must, n) AS (VALUES {templates}),
near AS (SELECT r, w FROM d WHERE list_contains(w, 'license') OR list_contains(w, 'cc')),
pos AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM near),
place AS (SELECT r, i - 1 AS i, label FROM pos JOIN ph ON i + n - 1 <= len(w) AND array_to_string(w[i : i + n - 1], ' ') = phrase),
pair AS (SELECT r, ls, label, tokens, must, n FROM d, te WHERE len(list_intersect(list_distinct(w), tokens)) >= must),
line AS (SELECT *, unnest(generate_series(1, len(ls))) AS i FROM pair),
upto AS (SELECT r, label, tokens, must, n, ls, i, len(ls[i]) AS own, sum(len(ls[i])) OVER o AS total, sum(CASE WHEN len(ls[i]) = 0 THEN 1 ELSE 0 END) OVER o AS blank FROM line WINDOW o AS (PARTITION BY r, label, tokens ORDER BY i)),
run AS (SELECT x.r, x.label, x.tokens, x.must, len(list_intersect(list_distinct(flatten(x.ls[x.i : y.i])), x.tokens)) AS k
        FROM upto x JOIN upto y ON x.r = y.r AND x.label = y.label AND x.tokens = y.tokens AND x.i <= y.i AND x.own > 0 AND x.blank = y.blank AND y.total - y.own - x.total <= x.n),
met AS (SELECT r, label, k / len(tokens) AS score FROM run WHERE k >= must),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT r, label, 1.0 AS score FROM place UNION ALL SELECT r, label, score FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r)
"""


_OP8 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""


def _op10() -> str:
    rules = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    return rf"""
WITH r(verdict, rule, h, p) AS (VALUES {rules}),
u AS (SELECT page_id, row_number() OVER () AS k, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT k, rule, verdict FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC, length(h) DESC, verdict DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
"""


ORACLES = {"op1_decontamination": _OP1, "op3_near_duplicates": _OP3, "op7_licenses": _op7(), "op8_nearest": _OP8, "op10_url_rules": _op10()}
