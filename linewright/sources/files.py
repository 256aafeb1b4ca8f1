"""Delimited files, read by Spark's text source, with the order of their records.

Rows carry ``_file`` and ``_pos``, dense within the file. A task reads the records of a split one
after another, so their ids ascend by one: a record's place in its split is its id less the split's
first one. One job over the files takes stock of the splits (their records, bytes, first record,
widest row, quotes) and writes a row for each to the shared folder; then the files are read once more
for the result, where records are not shuffled. Of quoted rows only those that run on from one split
into the next are put together in a shuffle, by one more scan that is planned only if there are such.

Whether a file ends with the delimiter follows from its size and its records' bytes, without opening
it; compressed files count as ending with it.
"""

from __future__ import annotations

import codecs

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linewright.functions import exprs, text
from linewright.functions.casing import normalize_names_col
from linewright.functions.delimiters import Delimiter, delimiter_bytes, parse_delimiter
from linewright.operators import tabular
from linewright.operators.jsonl import parse_json_rows
from linewright.session import materialise, ship_package
from linewright.sources import quoted

#: Splits up to which the table of splits is broadcast (a few hundred bytes each); more are joined by shuffling.
BROADCAST_SPLITS = 200_000
_COMPRESSED = r"\.(gz|bz2|zst|zstd|lz4|snappy|deflate)$"


def physical(spark: SparkSession, path: str, delimiter: bytes, reader=None) -> DataFrame:
    """(_file, _block, _size, raw): every record of every split, as its bytes are; _size is the file's.

    ``reader`` is the JVM's session that says how files are split (by default the one given).
    """
    # Only the delimiter is read in this encoding, in which every byte is a character.
    options = {"encoding": "ISO-8859-1", "lineSep": delimiter.decode("latin-1")}
    if reader is None:
        read = spark.read.options(**options).text(path)
    else:
        plan = reader.read().options(options).text(path).queryExecution().analyzed()
        read = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
    return read.select(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size"), F.col("value").alias("raw"))


def _settled(spark: SparkSession, delimiter: bytes):
    """A copy of the JVM's session in which files are split as they would be now: neither settings that change
    later nor executors that come and go part the survey from the reading.

    Files whose delimiter can overlap itself are not split: from the middle of a run of them the reader could not
    tell where one ends.
    """
    own = spark._jsparkSession.cloneSession()
    if any(delimiter[:k] == delimiter[-k:] for k in range(1, len(delimiter))):
        for name in ("maxPartitionBytes", "openCostInBytes"):
            own.conf().set(f"spark.sql.files.{name}", str(1 << 42))
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        own.conf().set("spark.sql.files.minPartitionNum", str(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism))
    return own


def _kept(raw: Column, skip_empty: bool, crlf: bool) -> Column:
    """Whether a record is emitted; the last one of a file, where a carriage return stays, is seen to elsewhere."""
    return (F.octet_length(raw) > 0) & (~(raw == "\r") if crlf else F.lit(True)) if skip_empty else F.lit(True)


def _survey(rows: DataFrame, delimiter: bytes, quotes: bool, skip_empty: bool, crlf: bool, comma: str | None) -> DataFrame:
    """A row for each split: its file and block, _size, _lines, _bytes, _quotes, _rows, _width, _head, _last, _first.

    _rows and _width are for a split that begins outside and inside of quotes.
    """
    if quotes:
        byte = ord(comma) if comma is not None and len(comma.encode()) == 1 else None
        return rows.withColumn("raw", F.col("raw").cast("binary")).mapInArrow(quoted.surveyed(delimiter, crlf, skip_empty, byte), quoted.SURVEY)
    # One scan for both: all records are counted, those that are emitted have rows.
    raw, keep = F.col("raw"), _kept(F.col("raw"), skip_empty, crlf)
    width = F.max(F.when(keep, F.size(exprs.split_plain(raw, comma)))) if comma is not None else F.lit(None).cast("int")
    at = F.col("_at")
    return rows.withColumn("_at", F.monotonically_increasing_id()).groupBy("_file", "_block").agg(
        F.max("_size").alias("_size"), F.count("*").alias("_lines"), F.sum(F.octet_length("raw")).alias("_bytes"), F.lit(0).cast("long").alias("_quotes"), F.array(F.count_if(keep)).alias("_rows"), F.array(width).alias("_width"),
        F.min_by(F.when(keep, raw), F.when(keep, at)).cast("binary").alias("_head"), F.max_by(raw, at).cast("binary").alias("_last"), F.min(at).alias("_first"),
    )


class Splits:
    """The splits of the files at ``path``, surveyed and written.

    ``files``: _file, _n (rows), _ended (whether with the delimiter), _open (whether in quotes), _lone (whether a last
    record is a carriage return alone that _n leaves out), _bom, _head (the first row). ``table``: of each split _file,
    _block, _inside (whether it begins in quotes), _crosses (whether it begins or ends in them), _base (rows before it),
    _id (of its first emitted record), _width, and of its file _end (the place of a last row that no delimiter ends, or
    -1) and _hold (whether that row then holds the delimiter behind it).
    """

    def __init__(self, spark: SparkSession, path: str, delimiter: bytes, *, quotes: bool, skip_empty: bool, crlf: bool, comma: str | None = None):
        self.spark, self.path, self.delimiter, self.reader = spark, path, delimiter, _settled(spark, delimiter)
        self.quotes, self.skip_empty, self.crlf, n = quotes, skip_empty, crlf, len(delimiter)
        if quotes:
            ship_package(spark)
        found = materialise(_survey(self._scan(), delimiter, quotes, skip_empty, crlf, comma), "survey")
        before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2
        own = found.withColumn("_inside", inside.cast("int")).withColumns({"_n": F.get("_rows", "_inside"), "_width": F.get("_width", "_inside"), "_crosses": (F.col("_inside") + F.col("_quotes") % 2) > 0})
        # Ids of a task's records go on from one split to the next: they are counted in the order of its first ones.
        task = F.shiftright("_first", 33)
        of_task = W.partitionBy(task).orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
        own = own.withColumn("_id", F.shiftleft(task, 33) + F.coalesce(F.sum("_n").over(of_task), F.lit(0)))
        own = own.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
        some = F.col("_n") > 0
        files = own.groupBy("_file").agg(F.sum("_n").alias("_n"), (F.sum(F.col("_bytes") + n * F.col("_lines")) - F.max("_size")).alias("_more"), (F.sum("_quotes") % 2 == 1).alias("_open"), F.max_by("_last", "_block").alias("_last"), F.min_by(F.when(some, F.struct("_head")), F.when(some, F.col("_block"))).alias("_h"))
        # What was read more than there is: a delimiter behind the last record; a byte order mark is not read.
        packed, more = F.col("_file").rlike(_COMPRESSED), F.col("_more")
        self.files = files.select("_file", "_n", (packed | more.isin(0, -3)).alias("_ended"), (~packed & more.isin(-3, n - 3) & ~more.isin(0, n)).alias("_bom"), "_open", "_last", F.col("_h._head").alias("_head"))
        # With empty records left out, a carriage return alone at the end is a row that no split counts.
        alone = (F.col("_last") == F.lit(b"\r")) & ~F.col("_ended") & ~F.col("_open")
        self.files = self.files.withColumn("_lone", alone if skip_empty and crlf else F.lit(False))
        odd = self.files.select("_file", F.when((~F.col("_ended") | F.col("_open")) & ~F.col("_lone"), F.col("_n") - 1).otherwise(-1).alias("_end"), (F.col("_ended") & F.col("_open")).alias("_hold"))
        self.table = materialise(own.join(odd, "_file").select("_file", "_block", "_inside", "_crosses", "_base", "_id", "_width", "_end", "_hold"), "splits")
        count, self.crossing = self.table.agg(F.count("*"), F.count_if("_crosses")).first()
        self.small = count <= BROADCAST_SPLITS

    def _scan(self) -> DataFrame:
        return physical(self.spark, self.path, self.delimiter, self.reader)

    def _with(self, rows: DataFrame, *names: str) -> DataFrame:
        """``rows`` beside what is known of their split."""
        known = self.table.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), *names)
        return rows.join(F.broadcast(known) if self.small else known, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b"))).drop("_f", "_b")

    def _lines(self) -> DataFrame:
        rows = self._scan().where(_kept(F.col("raw"), self.skip_empty, self.crlf)).withColumn("_own", F.monotonically_increasing_id())
        pos = F.col("_base") + F.col("_own") - F.col("_id")
        return self._with(rows, "_base", "_id", "_end").select("_file", pos.alias("_pos"), (pos == F.col("_end")).cast("int").alias("_odd"), "raw")

    def _rows(self) -> DataFrame:
        lines = self._scan().withColumn("_own", F.monotonically_increasing_id())
        lines = self._with(lines, "_inside", "_base", "_crosses", "_end", "_hold")
        if not self.small:  # the join moved the lines: they go back into the order of their split
            lines = lines.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_own")
        lines = lines.withColumn("raw", F.col("raw").cast("binary")).drop("_own")
        join = lambda df: df.mapInArrow(quoted.assembled(self.delimiter, self.crlf, self.skip_empty), quoted.ROWS)
        out = join(lines).where("_part = 0").select("_file", "_pos", "_odd", F.col("raw").cast("string").alias("raw"))
        if not self.crossing:
            return out
        parts = join(lines.where("_crosses")).where("_part = 1").groupBy("_file", "_pos").agg(F.max("_odd").alias("_odd"), F.array_sort(F.collect_list(F.struct("_block", "raw"))).alias("_parts"))
        latin = F.array_join(F.transform("_parts", lambda s: F.decode(s["raw"], "ISO-8859-1")), self.delimiter.decode("latin-1"))
        return out.unionAll(parts.select("_file", "_pos", "_odd", F.encode(latin, "ISO-8859-1").cast("string").alias("raw")))

    def records(self) -> DataFrame:
        """(_file, _pos, value) of every record."""
        raw, odd = F.col("raw"), F.col("_odd")
        # A last row that no delimiter ends keeps its carriage return; in quotes it holds all to the end of the file.
        value = F.when(odd == 2, F.concat(raw, F.lit(self.delimiter).cast("string"))).when(odd == 1, raw).otherwise(exprs.trim_return(raw) if self.crlf else raw)
        rows = (self._rows() if self.quotes else self._lines()).select("_file", "_pos", value.alias("value"))
        at = lambda df, pos, text: df.select("_file", pos.cast("long").alias("_pos"), F.lit(text).alias("value"))
        if self.skip_empty and self.crlf:
            rows = rows.unionAll(at(self.files.where("_lone"), F.col("_n"), "\r"))
        if not self.skip_empty:
            rows = rows.unionAll(at(self.files.where("_ended and not _open"), F.col("_n"), ""))
            rows = rows.unionAll(at(_listed(self.spark, self.path).join(self.files, "_file", "left_anti"), F.lit(0), ""))
        return rows


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(_file) of every file, empty ones too, as the session lists them for reading."""
    names = spark.read.text(path).inputFiles()
    return spark.createDataFrame([(n,) for n in names], "_f string").select(F.regexp_replace("_f", "^file:/+", "file:/").alias("_file"))


def _plain(encoding: str | None) -> bool:
    """Whether carriage returns and quotes are the bytes that they are in ASCII."""
    return encoding is None or codecs.encode('\r"', encoding) == b'\r"'


def _decoded(value: Column, encoding: str | None, fatal: bool, ignore_bom: bool, crlf: bool) -> Column:
    if encoding is None:
        return value
    out = text.decode(value.cast("binary"), encoding, fatal, ignore_bom)
    return exprs.trim_return(out) if crlf and not _plain(encoding) else out


def _check_quotes(delimiter: bytes, encoding: str | None) -> None:
    if b'"' in delimiter:
        raise ValueError("a delimiter that holds a quote cannot be quoted")
    if not _plain(encoding):
        raise ValueError(f"quotes are not one byte in {encoding}")


def _cut(rows: DataFrame, drop: int, take: int | None) -> DataFrame:
    drop = max(drop, 0)
    if drop:
        rows = rows.where(F.col("_pos") >= drop)
    if take is not None:
        rows = rows.where(F.col("_pos") < drop + max(take, 0))
    return rows.select("_file", (F.col("_pos") - drop).alias("_pos"), *[c for c in rows.columns if c not in ("_file", "_pos")])


def read_delimited(spark: SparkSession, path: str, delimiter: Delimiter = "\n", *, skip_empty: bool = True, crlf: bool = False, quotes: bool = False, drop: int = 0, take: int | None = None, encoding: str | None = None, fatal: bool = False, ignore_bom: bool = False) -> DataFrame:
    """(_file, _pos, value) of every record; ``_pos`` numbers the emitted ones of each file.

    ``drop`` and ``take`` count emitted records of each file, as does ``_pos``. With ``quotes`` a delimiter inside
    quotes ends nothing; an open quote holds the rest of its file. The delimiter may be any bytes. ``encoding``
    decodes every record (malformed UTF-8 becomes U+FFFD, or an error with ``fatal``; a byte order mark at its start
    goes, unless ``ignore_bom``); without it records have the bytes of the file. In encodings in which a carriage
    return is no single byte, such as UTF-16, one that ends a record goes after decoding and counts as its content.
    """
    d = delimiter_bytes(delimiter, encoding or "utf-8")
    if quotes:
        _check_quotes(d, encoding)
    splits = Splits(spark, path, d, quotes=quotes, skip_empty=skip_empty, crlf=crlf and _plain(encoding))
    rows = splits.records()
    if encoding is not None and ignore_bom:
        # Spark's reader takes the mark off a file's first record.
        marked = splits.files.where("_bom").select(F.col("_file").alias("_m"))
        rows = rows.join(marked, (F.col("_file") == F.col("_m")) & (F.col("_pos") == 0), "left").withColumn("value", F.when(F.col("_m").isNotNull(), F.concat(F.lit(codecs.BOM_UTF8).cast("string"), F.col("value"))).otherwise(F.col("value"))).drop("_m")
    rows = rows.withColumn("value", _decoded(F.col("value"), encoding, fatal, ignore_bom, crlf))
    return _cut(rows, drop, take)


def read_rows(spark: SparkSession, path: str, *, delimiter: Delimiter = "\n", crlf: bool = True, skip_empty: bool = True) -> DataFrame:
    """(_file, _pos, value): lines joined to rows whose quotes are closed, across splits."""
    return read_delimited(spark, path, delimiter, crlf=crlf, skip_empty=skip_empty, quotes=True)


def read_csv(spark: SparkSession, path: str, *, header: bool = True, mode: str = "object", column_delimiter: Delimiter = ",", quotes: bool = False, normalize_keys: bool | None = None, crlf: bool = True, skip_empty: bool = True, drop: int = 0, take: int | None = None, delimiter: Delimiter = "\n", encoding: str | None = None, fatal: bool = False, ignore_bom: bool = False, ragged: str = "columns", **options) -> DataFrame:
    """Shaped rows of delimited files, with ``_file`` and ``_pos`` (data rows from 0).

    The first record of every file is its header, for that file alone: objects have the columns of all headers,
    filled by name, and null where a file's header has no such name.
    """
    d, comma = delimiter_bytes(delimiter, encoding or "utf-8"), parse_delimiter(column_delimiter)
    if quotes:
        _check_quotes(d, encoding)
    splits = Splits(spark, path, d, quotes=quotes, skip_empty=skip_empty, crlf=crlf and _plain(encoding), comma=comma if mode == "object" and ragged == "columns" else None)
    rows = splits.records()
    value = _decoded(F.col("value"), encoding, fatal, ignore_bom, crlf)
    shape = {"mode": mode, "delimiter": column_delimiter, "quotes": quotes, "normalize_keys": normalize_keys, "ragged": ragged} | options
    cells = lambda v: exprs.split_columns(v, comma, quotes)
    widest = splits.table.groupBy("_file").agg(F.max("_width").alias("_w"))
    if quotes and mode == "object" and ragged == "columns":
        # Rows that cross splits are in no split's count, and neither is a delimiter of several bytes.
        if splits.crossing or len(comma.encode()) > 1:
            widest = rows.groupBy("_file").agg(F.max(F.size(cells(value))).alias("_w"))
    if not header:
        if mode == "object" and ragged == "columns":
            shape["width"] = widest.agg(F.max("_w")).first()[0] or 0
        return tabular.parse_rows(_cut(rows, drop, take).withColumn("value", value), "value", **shape)
    # A header that crosses splits is in no split's survey: it is looked for among the rows.
    heads = splits.files.select("_file", F.col("_head").cast("string").alias("value"))
    if not heads.where("value is null").isEmpty():
        heads = rows.where("_pos = 0").select("_file", "value")
    found = exprs.trim_return(value) if crlf else value
    names = F.coalesce(cells(found), F.array().cast("array<string>"))
    plain = normalize_keys is False or (normalize_keys is None and mode == "array")
    heads = materialise(heads.select("_file", (names if plain else normalize_names_col(names)).alias("_header")), "headers")
    rows = _cut(rows.where("_pos > 0").withColumn("_pos", F.col("_pos") - 1), drop, take)
    if mode == "array":
        return tabular.parse_rows(rows.withColumn("value", value), "value", **shape)
    few = heads.select("_header").distinct().limit(2).collect()
    if len(few) <= 1:
        one = list(few[0]["_header"]) if few else []
        if mode == "object" and ragged == "columns":
            shape["width"] = widest.agg(F.max("_w")).first()[0] or 0
        return tabular.parse_rows(rows.withColumn("value", value), "value", header=one, **(shape | {"normalize_keys": False}))
    union = tabular.name_union(heads, "_header")
    if mode == "object" and ragged == "columns":
        wide = heads.join(widest, "_file").where(F.col("_w") > F.size("_header")).agg(F.min(F.size("_header")), F.max("_w")).first()
        shape["width"] = (wide[0] or 0, wide[1] or 0)
    rows = rows.join(heads.withColumnRenamed("_file", "_f"), F.col("_file") == F.col("_f")).drop("_f")
    return tabular.parse_rows(rows.withColumn("value", value), "value", header="_header", names=union, **shape)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, **{"column_delimiter": tabular.TAB} | options)


def read_psv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, **{"column_delimiter": tabular.PIPE} | options)


def read_jsonl(spark: SparkSession, path: str, *, schema: str | None = None, **options) -> DataFrame:
    return parse_json_rows(read_delimited(spark, path, **options), "value", schema=schema, pos="_pos")
