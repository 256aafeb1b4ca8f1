"""The registered queries of the engine, each beside the SQL that gives the same rows.

Delimited inputs are made from columns of the tables (``concat_ws`` and the like) and parsed back.
"""

from __future__ import annotations

import asyncio
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright import cli
from linewright.functions import buffers, casing, exprs, ranges, text
from linewright.operators import combine, parallel, records, segments, tabular
from linewright.operators.jsonl import parse_json_rows, to_json_rows
from linewright.session import scratch_path
from linewright.sources import chunks, datasource, files, sinks
from linewright.streaming import lines as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir, value: Column | str = "text") -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", (F.col(value) if isinstance(value, str) else value).alias("text"))


def _unnested(lists: str, key: str = "doc_id", pos: str = "pos", value: str = "value", source: str = "documents") -> str:
    return f"SELECT {key}, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS {pos}, unnest(l) AS {value} FROM (SELECT {key}, {lists} AS l FROM {source})"


_LINES = "string_split(text, chr(10))"
_FULL = "list_filter({}, lambda x: strlen(x) > 0)"


def _blanks() -> Column:
    """Documents with blank lines, which the table's own have not."""
    return F.replace(F.col("text"), F.lit(". "), F.lit("\n\n"))


# Records


@query(_unnested(_FULL.format(_LINES)))
def split_lines(spark, sf_dir):
    return records.split_records(_docs(spark, sf_dir), "text")


@query(_unnested(_FULL.format("string_split(replace(text, '. ', chr(10) || chr(10)), chr(10))")))
def split_lines_skip_empty(spark, sf_dir):
    return records.split_records(_docs(spark, sf_dir, _blanks()), "text")


@query(_unnested("string_split(replace(text, '. ', chr(10) || chr(10)) || chr(10), chr(10))"))
def split_lines_keep_empty(spark, sf_dir):
    return records.split_records(_docs(spark, sf_dir, F.concat(_blanks(), F.lit("\n"))), "text", skip_empty=False)


@query(_unnested(_FULL.format("string_split(text, '. ')")))
def split_multibyte(spark, sf_dir):
    return records.split_records(_docs(spark, sf_dir), "text", ". ")


@query("SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS value FROM (SELECT doc_id, list_filter(list_transform(s, lambda x, i: CASE WHEN i < len(s) AND ends_with(x, chr(13)) THEN x[:-2] ELSE x END), lambda x: strlen(x) > 0) AS l FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(13) || chr(10)) || chr(13), chr(10)) AS s FROM documents))")
def crlf_trim(spark, sf_dir):
    crlf = F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit("\r"))
    return records.split_records(_docs(spark, sf_dir, crlf), "text", crlf=True)


@query(_unnested(_FULL.format("string_split(replace(text, chr(10), chr(13) || chr(10)), chr(10))")))
def crlf_kept(spark, sf_dir):
    return records.split_records(_docs(spark, sf_dir, F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))), "text")


@query(_unnested(f"list_slice({_FULL.format('string_split(replace(text, chr(46) || chr(32), chr(10) || chr(10)), chr(10))')}, 3, 5)"))
def take_drop(spark, sf_dir):
    return records.split_records(_docs(spark, sf_dir, _blanks()), "text", drop=2, take=3)


@query("SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS value FROM (SELECT page_id, list_filter(string_split(substr(url, 9), '/'), lambda x: strlen(x) > 0) AS l FROM pages)")
def split_from_position(spark, sf_dir):
    return records.split_records(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "/", position=8)


@query("WITH q AS (SELECT doc_id, string_split(text, '\"') AS s FROM documents), t AS (SELECT doc_id, string_split(array_to_string(list_transform(s, lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, chr(10), chr(1)) ELSE x END), '\"'), chr(1)) AS s FROM q) SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS value FROM (SELECT doc_id, list_filter(s, lambda x: strlen(x) > 0) AS l FROM t)")
def split_quoted_lines(spark, sf_dir):
    return records.split_records(_docs(spark, sf_dir), "text", quotes=True)


@query("WITH l AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS pos, unnest(p) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), b AS (SELECT doc_id, pos, value, octet_length(encode(value)) AS n FROM l) SELECT doc_id, pos, CAST(coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start, CAST(coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n AS BIGINT) AS byte_end, value FROM b")
def byte_ranges(spark, sf_dir):
    return records.byte_ranges(_docs(spark, sf_dir), "text")


@query("SELECT doc_id, CAST(strpos(text, ', ') - 1 AS BIGINT) AS first_match, CAST(CASE WHEN strpos(substr(text, 41), ', ') = 0 THEN -1 ELSE strpos(substr(text, 41), ', ') + 39 END AS BIGINT) AS from_40, CAST(strpos(substr(text, 1, 30), ', ') - 1 AS BIGINT) AS before_30 FROM documents")
def search_first(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", exprs.search(t, ", ").alias("first_match"), exprs.search(t, ", ", 40).alias("from_40"), exprs.search(t, ", ", 0, 30).alias("before_30"))


@query("SELECT doc_id, CAST(i - 1 AS BIGINT) AS \"offset\", CASE WHEN c = ',' THEN 0 ELSE 1 END AS pattern_id FROM (SELECT doc_id, unnest(t) AS c, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, string_split(text, '') AS t FROM documents)) WHERE c IN (',', '\"')")
def search_matches(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(exprs.search_matches(F.col("text"), ",")).alias("m")).select("doc_id", "m.offset", "m.pattern_id")


@query("SELECT page_id, CAST(i - 1 AS BIGINT) AS idx, CAST(coalesce(list_sum(list_transform(l[1 : i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start, CAST(coalesce(list_sum(list_transform(l[1 : i - 1], lambda x: length(x) + 1)), 0) + length(l[i]) AS BIGINT) AS \"end\" FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, string_split(url, '/') AS l FROM pages))")
def search_all(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(exprs.search_all(F.col("url"), "/")).alias("idx", "r"))
    return p.select("page_id", F.col("idx").cast("long").alias("idx"), "r.start", "r.end")


# Columns


def _customer(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.concat_ws(",", *[F.col(n).cast("string") for n in ("c_custkey", "c_name", "c_nationkey")], "c_mktsegment").alias("value"))


@query("SELECT c_custkey, array_to_string([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment], '|') AS cells, CAST(4 AS INTEGER) AS width FROM customer")
def csv_array(spark, sf_dir):
    rows = tabular.parse_rows(_customer(spark, sf_dir), mode="array")
    return rows.select("c_custkey", F.array_join("row", "|").alias("cells"), F.size("row").alias("width"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS cust_key, c_name AS full_name, CAST(c_nationkey AS VARCHAR) AS \"NATION\", c_mktsegment AS segment FROM customer")
def csv_object(spark, sf_dir):
    return tabular.parse_rows(_customer(spark, sf_dir), mode="object", header=["Cust Key", "fullName", "NATION", "segment"])


@query("SELECT c_custkey, unnest(['custkey', 'name', 'nation', 'column_3']) AS key, unnest([CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value, unnest([0, 1, 2, 3]) AS idx FROM customer")
def csv_entries(spark, sf_dir):
    rows = tabular.parse_rows(_customer(spark, sf_dir), mode="entries", header=["custkey", "name", "nation"])
    return rows.select("c_custkey", F.explode("row").alias("e")).select("c_custkey", "e.key", "e.value", "e.idx")


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text AS body, source AS origin FROM documents")
def csv_quoted(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    rows = d.select("doc_id", F.concat_ws(",", F.col("doc_id").cast("string"), quoted, "source").alias("value"))
    return tabular.parse_rows(rows, mode="object", header=["id", "body", "origin"], quotes=True)


@query("SELECT o_orderkey, o_orderpriority AS first, '\"' || o_orderstatus || ',' || o_custkey AS rest FROM orders")
def csv_quoted_unclosed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select("o_orderkey", F.concat("o_orderpriority", F.lit(',"'), "o_orderstatus", F.lit(","), F.col("o_custkey").cast("string")).alias("value"))
    return tabular.parse_rows(rows, mode="object", header=["first", "rest"], quotes=True)


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, text AS body FROM documents")
def csv_logical_rows(spark, sf_dir):
    quoted = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = table(spark, sf_dir, "documents").select("doc_id", quoted.alias("t")).select("doc_id", F.posexplode(F.split("t", "\n", -1)).alias("pos", "value"))
    rows = records.logical_rows(lines, ["pos"], ["doc_id"]).drop("row")
    return tabular.parse_rows(rows, mode="object", header=["id", "body"], quotes=True)


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS a, CASE WHEN c_custkey % 3 > 0 THEN c_name ELSE '' END AS b, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE '' END AS column_2 FROM customer")
def csv_ragged(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 3 == 0, key).when(F.col("c_custkey") % 3 == 1, F.concat_ws(",", key, "c_name")).otherwise(F.concat_ws(",", key, "c_name", "c_mktsegment"))
    return tabular.parse_rows(c.select("c_custkey", line.alias("value")), mode="object", header=["a", "b"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'a,b,column_2' ELSE 'a,b' END AS keys, CASE WHEN c_custkey % 3 = 0 THEN c_custkey || ',' WHEN c_custkey % 3 = 1 THEN c_custkey || ',' || c_name ELSE c_custkey || ',' || c_name || ',' || c_mktsegment END AS cells FROM customer")
def csv_ragged_map(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    line = F.when(F.col("c_custkey") % 3 == 0, key).when(F.col("c_custkey") % 3 == 1, F.concat_ws(",", key, "c_name")).otherwise(F.concat_ws(",", key, "c_name", "c_mktsegment"))
    rows = tabular.parse_rows(c.select("c_custkey", line.alias("value")), mode="object", header=["a", "b"], ragged="map")
    return rows.select("c_custkey", F.array_join(F.map_keys("row"), ",").alias("keys"), F.array_join(F.map_values("row"), ",").alias("cells"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS column_0, c_name AS column_1, CAST(c_nationkey AS VARCHAR) AS column_2, c_mktsegment AS column_3 FROM customer")
def csv_headerless(spark, sf_dir):
    return tabular.parse_rows(_customer(spark, sf_dir).select("value"), mode="object")


@query("SELECT p_partkey, upper(p_name) AS name, CAST(p_size AS DOUBLE) + 0.5 AS price, p_brand AS brand FROM part")
def csv_transformers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", F.concat_ws(",", "p_name", F.concat(F.lit("$ "), F.col("p_size").cast("string"), F.lit(".5")), "p_brand").alias("value"))
    price = lambda c: F.regexp_replace(c, "[^0-9.]", "").try_cast("double")
    return tabular.parse_rows(rows, mode="object", header=["Name", "Price", "brand"], transformers={"name": F.upper, "price": price})


@query("SELECT p_partkey, p_name AS x, p_type AS \"dup\" FROM part")
def csv_duplicate_header(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", "p_name", "p_brand", "p_type").alias("value"))
    return tabular.parse_rows(rows, mode="object", header=["x", "dup", "dup"], normalize_keys=False)


@query("SELECT s_suppkey, s_name AS name, '' AS middle, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def tsv_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("\t", "s_name", F.lit(""), F.col("s_nationkey").cast("string")).alias("value"))
    return tabular.parse_rows(rows, mode="object", header=["name", "middle", "nation"], delimiter=tabular.TAB)


@query("SELECT CAST(p_partkey AS VARCHAR) AS part_key, p_name AS name, p_type AS part_type FROM part")
def psv_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_type").alias("value"))
    return tabular.parse_rows(rows, mode="object", header=["Part Key", "name", "partType"], delimiter=tabular.PIPE)


@query("SELECT c_nationkey, i - 2 AS pos, CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer) WHERE i BETWEEN 2 AND 4")
def csv_documents(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda s: s["line"]), "\r\n")
    docs = c.groupBy("c_nationkey").agg(F.concat(F.lit("Key,Name\r\n\r\n"), body, F.lit("\r\n")).alias("doc"))
    return tabular.parse_documents(docs, "doc", mode="object", drop=1, take=3)


@query("SELECT o_orderkey, CAST(0 AS BIGINT) AS pos, CASE WHEN o_orderkey % 3 < 2 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority FROM orders")
def csv_documents_own_headers(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    doc = F.when(k == 0, F.concat(F.lit("status\n"), "o_orderstatus")).when(k == 1, F.concat(F.lit("priority,status\n"), "o_orderpriority", F.lit(","), "o_orderstatus")).otherwise(F.concat(F.lit("Priority\n"), "o_orderpriority"))
    return tabular.parse_documents(o.select("o_orderkey", doc.alias("doc")), "doc", mode="object", names=None, normalize_keys=True)


# JSON Lines


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsonl_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return parse_json_rows(e).select("event_id", F.variant_get("json", "$.k", "bigint").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsonl_typed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    return parse_json_rows(e, schema="struct<k:bigint>").select("event_id", "json.k")


_CUSTOMER_JSON = "CAST(to_json({c_custkey: c_custkey, c_name: c_name, none: CAST(NULL AS VARCHAR)}) AS VARCHAR)"


def _customer_null(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lit(None).cast("string").alias("none"))


@query(f"SELECT {_CUSTOMER_JSON} AS value FROM customer")
def csv_to_jsonl(spark, sf_dir):
    return to_json_rows(_customer_null(spark, sf_dir))


@query("SELECT c_custkey || ',' || c_name || ',' AS value FROM customer")
def jsonl_to_csv(spark, sf_dir):
    parsed = parse_json_rows(to_json_rows(_customer_null(spark, sf_dir)), schema="struct<c_custkey:bigint,c_name:string,none:string>").select("json.*")
    return sinks.csv_lines(parsed)


# Text


@query("SELECT c_custkey, c_name AS stripped, chr(65279) || c_name AS kept FROM customer")
def bom_strip(spark, sf_dir):
    raw = F.encode(F.concat(F.lit("\ufeff"), F.col("c_name")), "UTF-8")
    return table(spark, sf_dir, "customer").select("c_custkey", text.decode(raw).alias("stripped"), text.decode(raw, ignore_bom=True).alias("kept"))


@query("SELECT doc_id, text || chr(65533) || 'x' AS value FROM documents")
def text_decode_invalid(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.decode(F.concat(F.col("text").cast("binary"), F.lit(b"\xffx"))).alias("value"))


@query("SELECT c_custkey, 'é' || c_name AS value FROM customer")
def text_decode_latin1(spark, sf_dir):
    raw = F.concat(F.lit(b"\xe9"), F.col("c_name").cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.decode(raw, "iso-8859-1").alias("value"))


@query("SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS value FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: strlen(x) > 0) AS l FROM documents)")
def binary_records(spark, sf_dir):
    raw = F.replace(F.col("text"), F.lit(" "), F.lit("\x01")).cast("binary")
    # Bytes that no text holds part the records: 0xFE, put in after encoding.
    raw = F.encode(F.translate(F.decode(raw, "ISO-8859-1"), "\x01", "\xfe"), "ISO-8859-1")
    rows = records.split_records(table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")), "raw", 0xFE)
    return rows.withColumn("value", F.col("value").cast("string"))


@query("SELECT doc_id, translate(text, chr(10) || chr(13) || ', ' || chr(9) || chr(30), chr(9252) || chr(9229) || '-' || chr(9248) || chr(9225) || chr(9246)) AS value FROM documents")
def visible_chars(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", exprs.visible_characters(F.col("text")).alias("value"))


# Letter case

_PART_NAME = "p_name || ' ' || p_type"
_PARTED = "regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
_SPLIT = f"list_filter(regexp_split_to_array({_PARTED}, '[^A-Za-z0-9]+'), lambda x: x <> '')"


def _names(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("n"))


@query(f"SELECT p_partkey, CASE WHEN upper(n) = n THEN regexp_replace(n, '[^A-Za-z0-9_]+', '_', 'g') ELSE lower(array_to_string({_SPLIT}, '_')) END AS value FROM (SELECT p_partkey, {_PART_NAME} AS n FROM part)")
def snake_case(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", casing.snake_case_col(F.col("n")).alias("value"))


@query(f"SELECT p_partkey, CASE WHEN upper(n) = n THEN n ELSE array_to_string(list_transform({_SPLIT}, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE upper(x[1]) || lower(x[2:]) END), '') END AS value FROM (SELECT p_partkey, {_PART_NAME} AS n FROM part)")
def camel_case(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", casing.camel_case_col(F.col("n")).alias("value"))


@query(f"SELECT p_partkey, CASE WHEN n = upper(n) OR n = lower(n) THEN n ELSE array_to_string(list_transform({_SPLIT}, lambda x: upper(x[1]) || lower(x[2:])), ' ') END AS value FROM (SELECT p_partkey, {_PART_NAME} AS n FROM part)")
def capital_case(spark, sf_dir):
    return _names(spark, sf_dir).select("p_partkey", casing.capital_case_col(F.col("n")).alias("value"))


@query("SELECT o_orderkey, o_orderpriority = upper(o_orderpriority) OR o_orderpriority = lower(o_orderpriority) AS uniform, false AS of_null FROM orders")
def uniformly_cased(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", casing.uniformly_cased_col(F.col("o_orderpriority")).alias("uniform"), casing.uniformly_cased_col(F.lit(None).cast("string")).alias("of_null"))


def _snake(n: str) -> str:
    return f"(SELECT CASE WHEN upper(n) = n THEN regexp_replace(n, '[^A-Za-z0-9_]+', '_', 'g') ELSE lower(array_to_string({_SPLIT}, '_')) END FROM (SELECT {n} AS n))"


@query(f"SELECT p_partkey, {_snake('p_name')} || ',' || {_snake('p_type')} || ',' || {_snake('p_name')} || '_2,' || {_snake('p_name')} || '_3,' || {_snake('p_brand')} AS names FROM part")
def normalize_columns(spark, sf_dir):
    names = F.array("p_name", "p_type", "p_name", "p_name", "p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(casing.normalize_names_col(names), ",").alias("names"))


# Combining


@query("SELECT CAST(coalesce(a.i, b.i) AS BIGINT) AS idx, o_orderkey, event_type FROM (SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS i, o_orderkey FROM orders) a FULL JOIN (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, event_type FROM events) b ON a.i = b.i")
def zip_rows(spark, sf_dir):
    o, e = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return combine.zip_rows(o, e, [F.desc("o_orderkey")], ["ts", "event_id"]).select("idx", "o_orderkey", "event_type")


@query("SELECT doc_id, unnest(range(0, greatest(2, len(l)))) AS pos, unnest(list_transform(range(1, greatest(2, len(l)) + 1), lambda i: [lang, source][i])) AS a, unnest(list_transform(range(1, greatest(2, len(l)) + 1), lambda i: l[i])) AS b FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)")
def zip_without_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array("lang", "source").alias("x"), F.split("text", "\n", -1).alias("y"))
    z = d.select("doc_id", F.posexplode(combine.without_index(combine.zip_arrays(F.col("x"), F.col("y")))).alias("pos", "z"))
    return z.select("doc_id", F.col("pos").cast("long").alias("pos"), "z.a", "z.b")


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, w[i] AS word, l[i] AS line FROM (SELECT doc_id, w, l, unnest(range(1, greatest(len(w), len(l)) + 1)) AS i FROM (SELECT doc_id, string_split(source || '/' || lang, '/') AS w, string_split(text, chr(10)) AS l FROM documents))")
def zip_arrays(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws("/", "source", "lang"), "/").alias("w"), F.split("text", "\n", -1).alias("l"))
    z = d.select("doc_id", F.explode(combine.zip_arrays(F.col("w"), F.col("l"))).alias("z"))
    return z.select("doc_id", F.col("z.idx").alias("idx"), F.col("z.a").alias("word"), F.col("z.b").alias("line"))


@query("SELECT c_custkey AS key, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part")
def merge_union(spark, sf_dir):
    named = lambda t, k, n: table(spark, sf_dir, t).select(F.col(n).alias("name"), F.col(k).alias("key"))
    return combine.merge(named("customer", "c_custkey", "c_name").select("key", "name"), named("supplier", "s_suppkey", "s_name"), named("part", "p_partkey", "p_name"))


@query("SELECT CAST(i // 64 AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY i) AS ids FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events) GROUP BY 1")
def batch_n(spark, sf_dir):
    e = combine.numbered(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], "pos")
    return combine.batch(e, "pos", "event_id", 64).select("batch", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("ids"))


# Buffers


@query("SELECT o_orderkey, CAST(octet_length(encode(o_orderpriority || o_orderstatus || 'xy')) AS BIGINT) AS n, CAST(ascii(o_orderpriority) AS INTEGER) AS first, substr(o_orderpriority || o_orderstatus || 'xy', 2, 3) AS part, right(o_orderpriority || o_orderstatus || 'xy', 2) AS tail, o_orderstatus || 'xy' AS rest FROM orders")
def composite_buffer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_orderpriority").cast("binary"), F.col("o_orderstatus").cast("binary")).alias("c"))
    o = o.withColumn("c", buffers.append(F.col("c"), F.lit(b"xy"))).withColumn("f", buffers.flat(F.col("c")))
    return o.select("o_orderkey", buffers.byte_length(F.col("c")).alias("n"), buffers.byte_at(F.col("f"), 0).alias("first"), buffers.subarray(F.col("f"), 1, 4).cast("string").alias("part"), buffers.slice_bytes(F.col("f"), -2).cast("string").alias("tail"), buffers.flat(buffers.remove_first(F.col("c"))).cast("string").alias("rest"))


@query("SELECT o_orderkey, CAST(o_custkey + 3 AS BIGINT) AS first_end, CAST(9 AS BIGINT) AS last_start, CAST(o_custkey + 4 AS BIGINT) AS n, CAST(1 AS INTEGER) AS left_over FROM orders")
def range_queue(spark, sf_dir):
    q = ranges.enqueue(ranges.enqueue(ranges.queue(), 0, F.col("o_custkey") + 3), 9, 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", ranges.peek(q)["end"].alias("first_end"), ranges.peek_last(q)["start"].alias("last_start"), ranges.byte_length(q).alias("n"), F.size(ranges.dequeue(q)).alias("left_over"))


@query("SELECT p_partkey, 'xy' || substr(p_name, 3) AS written, CAST(greatest(20, length(p_name)) AS INTEGER) AS grown, substr(p_name, 2, 2) AS kept, repeat('00', length(p_name)) AS cleared FROM part")
def growable_buffer(spark, sf_dir):
    v = F.col("p_name").cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", buffers.set_bytes(v, F.lit(b"xy"), 0).cast("string").alias("written"), F.octet_length(buffers.grow(v, 20)).alias("grown"), buffers.compress(v, 1, 3).cast("string").alias("kept"), F.hex(buffers.clear(v)).alias("cleared"))


@query("SELECT page_id, substr(url, 9, 12) AS part, substr(url, 31, 1000) AS rest FROM pages")
def read_window(spark, sf_dir):
    v = F.col("url").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", buffers.read_window(v, 8, 12).cast("string").alias("part"), buffers.read_window(v, 30, 1000).cast("string").alias("rest"))


# Segments and user functions

_CUTS = "list_filter([CASE WHEN {at} > 0 AND {at} < n AND strpos(substr(text, {at} + 1), chr(10)) > 0 AND {at} + strpos(substr(text, {at} + 1), chr(10)) < n THEN {at} + strpos(substr(text, {at} + 1), chr(10)) END], lambda x: x IS NOT NULL)"
_SEGMENTS = "WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents), b AS (SELECT doc_id, text, list_sort(list_distinct([0, n] || " + " || ".join(_CUTS.format(at=f"CAST(floor({k} * n / 4.0 + 0.5) AS BIGINT)") for k in (1, 2, 3)) + ")) AS b FROM d WHERE n > 0), s AS (SELECT doc_id, text, CAST(i - 1 AS BIGINT) AS segment, CAST(b[i] AS BIGINT) AS start, CAST(b[i + 1] AS BIGINT) AS \"end\" FROM (SELECT doc_id, text, b, unnest(range(1, len(b))) AS i FROM b)) "


@query(_SEGMENTS + 'SELECT doc_id, segment, start, "end", substr(text, start + 1, "end" - start) AS part FROM s')
def segment_ranges(spark, sf_dir):
    return segments.split_segments(_docs(spark, sf_dir), "text", 4)


@query(_SEGMENTS + "SELECT doc_id, segment, CAST(len(list_filter(string_split(substr(text, start + 1, \"end\" - start), chr(10)), lambda x: strlen(x) > 0)) AS BIGINT) AS n_records FROM s")
def as_many_counts(spark, sf_dir):
    parts = segments.split_segments(_docs(spark, sf_dir), "text", 4)
    return parts.select("doc_id", "segment", F.size(records.records(F.col("part"))).cast("long").alias("n_records"))


@query("SELECT translate(l, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS result FROM (SELECT unnest(list_filter(string_split(text, chr(10)), lambda x: strlen(x) > 0)) AS l FROM documents)")
def map_records_upper(spark, sf_dir):
    small, capital = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    capitals = str.maketrans(small, capital)
    return parallel.map_records(split_lines(spark, sf_dir), "value", lambda v, ctx: v.translate(capitals), "string")


@query("SELECT event_id * 2 AS result FROM events WHERE event_id % 2 = 0")
def parallel_map_evens(spark, sf_dir):
    return parallel.parallel_map(table(spark, sf_dir, "events"), "event_id", lambda v, ctx: parallel.SKIP if v % 2 else int(v) * 2, "bigint", concurrency=4)


@query("SELECT event_id * 3 + 7 AS result FROM events")
def map_records_async(spark, sf_dir):
    async def handle(value, context):
        await asyncio.sleep(0)
        return value * 3 + context.user_data

    return parallel.map_records(table(spark, sf_dir, "events"), "event_id", handle, "bigint", user_data=7, max_in_flight=3)


_SET_UP: list[int] = []


@query("SELECT 'k' || o_orderkey AS result FROM orders")
def map_records_setup(spark, sf_dir):
    return parallel.map_records(table(spark, sf_dir, "orders"), "o_orderkey", lambda v, ctx: f"{ctx.user_data['prefix']}{v}" if _SET_UP and ctx.index >= 0 else None, "string", user_data={"prefix": "k"}, setup=lambda: _SET_UP.append(1))


# Files and streams


def _line_files(spark, sf_dir, name: str) -> str:
    """Orders as comma-separated lines, in a few files under the shared folder."""
    path = scratch_path(spark, name)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("value"))
    sinks.write_lines(o, path)
    return path


_ORDER_LINES = "SELECT o_orderkey || ',' || o_orderstatus || ',' || o_orderpriority AS value FROM orders"


@query(_ORDER_LINES)
def writer_round_trip(spark, sf_dir):
    return files.read_delimited(spark, _line_files(spark, sf_dir, "lines")).select("value")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS column_0, o_orderstatus AS column_1, o_orderpriority AS column_2 FROM orders")
def csv_files(spark, sf_dir):
    return files.read_csv(spark, _line_files(spark, sf_dir, "csv"), header=False).drop("_file", "_pos")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text AS body FROM documents")
def csv_quoted_files(spark, sf_dir):
    path = scratch_path(spark, "quoted")
    quoted = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    sinks.write_lines(table(spark, sf_dir, "documents").select(quoted.alias("value")), path)
    return tabular.parse_rows(files.read_rows(spark, path), mode="object", header=["id", "body"], quotes=True).select("id", "body")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def jsonl_files(spark, sf_dir):
    path = scratch_path(spark, "jsonl")
    sinks.write_jsonl(table(spark, sf_dir, "events").select("event_id", "props"), path)
    return files.read_jsonl(spark, path, schema="struct<event_id:bigint,props:string>").select("json.event_id", F.get_json_object("json.props", "$.k").cast("bigint").alias("k"))


@query(_ORDER_LINES)
def stream_lines(spark, sf_dir):
    source, out = _line_files(spark, sf_dir, "stream-in"), scratch_path(spark, "stream-out")
    streaming.write_stream(streaming.read_stream(spark, source), out, scratch_path(spark, "stream-state")).awaitTermination()
    return spark.read.option("lineSep", "\n").text(out)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS value, CAST(octet_length(encode(CAST(o_orderkey AS VARCHAR))) AS BIGINT) AS n FROM orders")
def delimited_source(spark, sf_dir):
    path = scratch_path(spark, "single")
    sinks.write_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value")), path, delimiter="||", single=True)
    datasource.register(spark)
    [part] = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect()]
    got = spark.read.format("delimited").options(delimiter="||", concurrency="5").load(part)
    return got.select(F.col("value").cast("string").alias("value"), (F.col("byte_end") - F.col("byte_start")).alias("n"))


@query("SELECT CAST(sum(octet_length(encode(CAST(o_orderkey AS VARCHAR))) + 1) AS BIGINT) AS n_bytes, CAST(ceil(sum(octet_length(encode(CAST(o_orderkey AS VARCHAR))) + 1) / 1024) AS BIGINT) AS n_chunks FROM orders")
def file_chunks(spark, sf_dir):
    path = scratch_path(spark, "chunks")
    sinks.write_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value")), path, single=True)
    [part] = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect()]
    return chunks.read_chunks(spark, part, 1024).agg(F.sum(F.octet_length("bytes")).alias("n_bytes"), F.count("*").alias("n_chunks"))


def _two_headers(spark, sf_dir, name: str) -> str:
    """Orders in two files whose headers name their columns in different orders."""
    path, o = scratch_path(spark, name), table(spark, sf_dir, "orders")
    key, status, priority = F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.concat(F.lit('"'), "o_orderpriority", F.lit(',\n"'))
    for part, header, cells in ((0, "Order Key,status,Priority", (key, status, priority)), (1, "Priority,Order Key", (priority, key))):
        rows = o.where(F.col("o_orderkey") % 2 == part).select(F.col("o_orderkey").alias("k"), F.concat_ws(",", *cells).alias("value"))
        rows = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(header).alias("value")).unionAll(rows)
        sinks.write_lines(rows, path, order=["k"], single=True, mode="append")
    return path


@query("SELECT CAST(o_orderkey AS VARCHAR) AS order_key, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status, o_orderpriority || ',' || chr(10) AS priority FROM orders")
def csv_header_files_quoted(spark, sf_dir):
    return files.read_csv(spark, _two_headers(spark, sf_dir, "headers-quoted"), quotes=True).select("order_key", "status", "priority")


_EVEN_LINES = """SELECT unnest([CAST(o_orderkey AS VARCHAR), '"']) AS order_key, unnest([o_orderstatus, '']) AS status, unnest(['"' || o_orderpriority, '']) AS priority FROM orders WHERE o_orderkey % 2 = 0"""
_ODD_LINES = """SELECT unnest(['', CAST(o_orderkey AS VARCHAR)]), unnest([CAST(NULL AS VARCHAR), NULL]), unnest(['"' || o_orderpriority, '"']) FROM orders WHERE o_orderkey % 2 = 1"""


@query(f"{_EVEN_LINES} UNION ALL {_ODD_LINES}")
def csv_header_files_raw(spark, sf_dir):
    """The same files without quotes: each order's two lines are rows of their own."""
    return files.read_csv(spark, _two_headers(spark, sf_dir, "headers-raw"), ragged="drop").drop("_file", "_pos")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text AS the_body, lang FROM documents")
def csv_quoted_header_files(spark, sf_dir):
    path = scratch_path(spark, "quoted-header")
    quoted = F.concat_ws(",", F.col("doc_id").cast("string"), F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"')), "lang")
    head = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit('id,"The Body",lang').alias("value"))
    rows = head.unionAll(table(spark, sf_dir, "documents").select("doc_id", quoted))
    sinks.write_lines(rows, path, order=["k"], single=True)
    return files.read_csv(spark, path, quotes=True).drop("_file", "_pos")


def _parts_with(spark, sf_dir, name: str, delimiter: str) -> str:
    path = scratch_path(spark, name)
    head = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit(delimiter.join(("Key", "partName", "BRAND"))).alias("value"))
    rows = head.unionAll(table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(delimiter, F.col("p_partkey").cast("string"), "p_name", "p_brand")))
    sinks.write_lines(rows, path, order=["k"], single=True)
    return path


_PARTS = 'SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS part_name, p_brand AS "BRAND", CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS _pos FROM part'


@query(_PARTS)
def tsv_files(spark, sf_dir):
    return files.read_tsv(spark, _parts_with(spark, sf_dir, "tsv", tabular.TAB)).drop("_file")


@query(_PARTS)
def psv_files(spark, sf_dir):
    return files.read_psv(spark, _parts_with(spark, sf_dir, "psv", tabular.PIPE)).drop("_file")


@query("SELECT unnest(list_filter([o_orderstatus, '\"' || o_orderpriority || '|' || o_custkey || '\"', CAST(o_orderkey AS VARCHAR)], lambda x: strlen(x) > 0)) AS value FROM orders")
def quoted_delimiter_files(spark, sf_dir):
    path = scratch_path(spark, "bars")
    quoted = F.concat(F.lit('"'), "o_orderpriority", F.lit("|"), F.col("o_custkey").cast("string"), F.lit('"'))
    sinks.write_lines(table(spark, sf_dir, "orders").select(F.concat_ws("|", "o_orderstatus", quoted, F.col("o_orderkey").cast("string")).alias("value")), path, delimiter="|")
    return files.read_delimited(spark, path, "|", quotes=True).select("value")


@query("SELECT c_name || chr(195) AS value FROM customer")
def byte_delimiter_files(spark, sf_dir):
    # The last byte of each ü parts the records; its first one stays and is read as Latin-1.
    path = scratch_path(spark, "bytes")
    sinks.write_lines(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), path, delimiter="ü")
    return files.read_delimited(spark, path, 0xBC, encoding="iso-8859-1").select("value")


@query("SELECT 'ü' || c_name AS as_utf8, chr(195) || chr(188) || c_name AS as_latin1 FROM customer")
def encoded_files(spark, sf_dir):
    path = scratch_path(spark, "encoded")
    sinks.write_lines(table(spark, sf_dir, "customer").select(F.concat(F.lit("ü"), "c_name").alias("value")), path)
    utf8 = files.read_delimited(spark, path, encoding="utf-8").select("_file", "_pos", F.col("value").alias("as_utf8"))
    latin1 = files.read_delimited(spark, path, encoding="iso-8859-1").select("_file", "_pos", F.col("value").alias("as_latin1"))
    return utf8.join(latin1, ["_file", "_pos"]).select("as_utf8", "as_latin1")


@query(_ORDER_LINES)
def dispatched_path(spark, sf_dir):
    return chunks.records_from(spark, _line_files(spark, sf_dir, "dispatched")).select("value")


@query(_unnested(_FULL.format(_LINES)).replace("SELECT doc_id, ", "SELECT ", 1))
def dispatched_column(spark, sf_dir):
    return chunks.records_from(spark, _docs(spark, sf_dir).select("text"))


@query("SELECT event_type || '!' AS value FROM events WHERE event_type <> 'click'")
def command_line(spark, sf_dir):
    """``iterate`` with a filter and a transformer, from a file to a file; tasks write both."""
    folder = sinks.local_path(spark, scratch_path(spark, "command"))
    os.makedirs(folder)
    sinks.write_file(table(spark, sf_dir, "events"), f"{folder}/in.txt", "event_type", delimiter="|")
    with open(f"{folder}/user.py", "w", encoding="utf-8") as f:
        f.write("from pyspark.sql import functions as F\n\n\ndef filter(c):\n    return c != 'click'\n\n\ndef transform(c):\n    return F.concat(c, F.lit('!'))\n")
    cli.run(["iterate", f"{folder}/in.txt", f"{folder}/out.txt", "-s", "|", "-f", f"{folder}/user.py", "-T", f"{folder}/user.py"], spark)
    return spark.read.text(f"{folder}/out.txt")


@query("SELECT CAST(p_partkey AS VARCHAR) AS key, upper(p_name) AS part_name, p_brand AS \"BRAND\" FROM part")
def command_line_csv(spark, sf_dir):
    """``csv`` with transformers: JSON Lines, read back."""
    folder = sinks.local_path(spark, scratch_path(spark, "command-csv"))
    os.makedirs(folder)
    with open(f"{folder}/user.py", "w", encoding="utf-8") as f:
        f.write("from pyspark.sql import functions as F\n\ntransformers = {'part_name': F.upper}\n")
    cli.run(["csv", _parts_with(spark, sf_dir, "command-parts", ";"), f"{folder}/out.jsonl", "-c", ";", "--transformers", f"{folder}/user.py"], spark)
    return spark.read.schema("key string, part_name string, BRAND string").json(f"{folder}/out.jsonl")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, text AS body FROM documents")
def stream_csv(spark, sf_dir):
    source, out = scratch_path(spark, "stream-csv"), scratch_path(spark, "stream-csv-out")
    quoted = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    sinks.write_lines(table(spark, sf_dir, "documents").select(quoted.alias("value")), source)
    rows = streaming.read_csv_stream(spark, source, names=["id", "body"], header=False, quotes=True).select("id", "body")
    rows.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream-csv-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("id string, body string").parquet(out)


@query("SELECT CAST(i - 1 AS BIGINT) AS pos, CAST(o_orderkey AS VARCHAR) AS value FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 5 AS i FROM orders) WHERE i BETWEEN 1 AND 100")
def stream_drop_take(spark, sf_dir):
    source, out = scratch_path(spark, "stream-drop"), scratch_path(spark, "stream-drop-out")
    sinks.write_lines(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("value")), source, order=["o_orderkey"], single=True, delimiter="\r\n")
    rows = streaming.read_stream(spark, source, crlf=True, drop=5, take=100)
    rows.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream-drop-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema("pos long, value string").parquet(out)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def delimited_folder(spark, sf_dir):
    path = scratch_path(spark, "folder")
    sinks.write_lines(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("value")), path, delimiter="||")
    datasource.register(spark)
    return spark.read.format("delimited").options(delimiterHex="7c7c", concurrency="3").load(path).select(F.col("value").cast("string").alias("value"))


@query("SELECT CAST(1000 AS BIGINT) AS n_bytes, CAST(16 AS BIGINT) AS n_chunks, substr(string_agg(CAST(o_orderkey AS VARCHAR) || chr(10), '' ORDER BY o_orderkey), 501, 1000) AS content FROM orders")
def chunk_range(spark, sf_dir):
    path = scratch_path(spark, "chunk-range")
    sinks.write_lines(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("value")), path, order=["o_orderkey"], single=True)
    [part] = [r[0] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").collect()]
    found = chunks.read_chunks(spark, part, 64, 500, 1499)
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "bytes"))), lambda c: c["bytes"].cast("string")), "")
    return found.agg(F.sum(F.octet_length("bytes")).alias("n_bytes"), F.count("*").alias("n_chunks"), content.alias("content"))


@query("SELECT r_name AS value, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS pos FROM region")
def driver_values(spark, sf_dir):
    """What ``to_array`` brings to the driver: for results that fit there."""
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("value"))
    return spark.createDataFrame([(k, v) for k, v in enumerate(sinks.to_array(r))], "pos long, value string")
