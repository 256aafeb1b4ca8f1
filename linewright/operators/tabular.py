"""Delimited columns: CSV, TSV and pipe-separated rows with exact empty, ragged and quoted cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import exprs
from linewright.functions.casing import normalize_column_names, normalize_names_col
from linewright.functions.delimiters import Delimiter, parse_delimiter
from linewright.operators.records import records

COMMA, TAB, PIPE = ",", "\t", "|"
Transformers = dict[str, Callable[[Column], Column]] | list[Callable[[Column], Column]]


def _transform(transformers: Transformers | None, name: str, index: int) -> Callable[[Column], Column]:
    if isinstance(transformers, dict):
        return transformers.get(name, lambda c: c)
    if transformers and index < len(transformers) and transformers[index] is not None:
        return transformers[index]
    return lambda c: c


def cell(columns: Column, index: int) -> Column:
    """The cell at ``index``; a row that is too short has an empty one."""
    return F.coalesce(F.get(columns, index), F.lit(""))


def entries(columns: Column, header: list[str] | Column, transformers: Transformers | None = None) -> Column:
    """(key, value, idx) of every cell; missing cells are empty, further ones keyed column_<idx>.

    ``header`` is a list, or an array column when rows have headers of their own.
    """
    own = isinstance(header, Column)
    keys = header if own else F.array(*[F.lit(h) for h in header]) if header else F.array().cast("array<string>")
    width = F.greatest(F.size(columns), F.size(keys))
    index = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))

    def value(i: Column) -> Column:
        raw = F.coalesce(F.get(columns, i), F.lit(""))
        out = raw
        by_name = own and isinstance(transformers, dict)
        for k, name in enumerate(header if not own else transformers or []):
            made = _transform(transformers, name, k)(raw)
            its = F.get(keys, i) == name if by_name else (i == k) & (i < F.size(keys))
            out = out if made is raw else F.when(its, made.cast("string")).otherwise(out)
        return out

    return F.transform(index, lambda i: F.struct(F.coalesce(F.get(keys, i), F.concat(F.lit("column_"), i.cast("string"))).alias("key"), value(i).alias("value"), i.alias("idx")))


def _free(name: str, taken: set[str]) -> str:
    """``name``, or the first of name_2, name_3 … that is not taken in any case; it then is."""
    fresh, k = name, 1
    while fresh.lower() in taken:
        k += 1
        fresh = f"{name}_{k}"
    taken.add(fresh.lower())
    return fresh


def last_place(names: Column, name: str) -> Column:
    """Where ``name`` stands last in an array of names, from 0; null where it does not."""
    back = F.array_position(F.reverse(names), name)
    return F.when(back > 0, F.size(names) - back).cast("int")


def name_union(headers: DataFrame, header: str) -> list[str]:
    """The names of all headers, by the first place they have in any, then by name: one row for each comes to the driver."""
    rows = headers.select(F.posexplode(header).alias("i", "name")).groupBy("name").agg(F.min("i").alias("i")).collect()
    return [r["name"] for r in sorted(rows, key=lambda r: (r["i"], r["name"]))]


def parse_rows(rows: DataFrame, value: str = "value", *, header: list[str] | str | None = None, names: list[str] | None = None, mode: str = "array", delimiter: Delimiter = COMMA, quotes: bool = False, normalize_keys: bool | None = None, transformers: Transformers | None = None, ragged: str = "columns", width: int | tuple[int, int] | None = None, out: str = "row") -> DataFrame:
    """Rows whose ``value`` is one delimited record -> shaped rows; the other columns stay.

    mode ``array``: the cells as an array in ``out``, no transformer runs; ``entries``: an array of
    (key, value, idx) in ``out``; ``object``: a column for each header name. What a row has beyond
    the header comes out as column_<idx> columns (ragged="columns", one pass for the widest row unless
    ``width`` says it), as a map of name to cell in ``out`` (ragged="map"), or not at all (ragged="drop").
    Of equal names the last one's cell stays. ``normalize_keys`` defaults to true but for arrays.

    ``header`` is the list of names, or the name of an array column that holds each row's own ones, final as
    they are. Objects then have the columns ``names`` (by default those of all headers, in one pass), and null
    where a row's header has no such name; ``width`` is then the size of the shortest header that a row goes
    beyond, and of the widest of these rows. A column that is called like one of the other columns, in any case,
    gets a number: theirs stay.
    """
    if mode not in ("array", "entries", "object"):
        raise ValueError(f"no such mode: {mode}")
    d = parse_delimiter(delimiter)
    own = isinstance(header, str)
    normalize = mode != "array" if normalize_keys is None else normalize_keys
    fixed = [] if own else list(header or [])
    if normalize:
        fixed = normalize_column_names(fixed)
    cells = exprs.split_columns(F.col(value), d, quotes)
    kept = [c for c in rows.columns if c != value and not (own and c == header)]
    if mode == "array":
        return rows.select(*kept, cells.alias(out))
    split = rows.withColumn("_cells", cells)
    if own and names is None and mode == "object" and ragged != "map":
        names = name_union(rows.select(header).distinct(), header)
    keyed = entries(F.col("_cells"), F.col(header) if own else fixed, transformers)
    if mode == "entries":
        return split.select(*kept, keyed.alias(out))
    if ragged == "map":
        pairs = F.transform(keyed, lambda e: F.struct(e["key"], e["value"]))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
        return split.select(*kept, F.map_from_entries(last).alias(out))
    most, shortest = len(fixed), 0
    if ragged == "columns" and own:
        # The first place that is beyond a header, and the last one that a row fills.
        found = split.where(F.size("_cells") > F.size(header)).agg(F.min(F.size(header)), F.max(F.size("_cells"))).first() if width is None else width
        shortest, most = found[0] or 0, found[1] or 0
    elif ragged == "columns":
        most = max(most, (split.agg(F.max(F.size("_cells"))).first()[0] or 0) if width is None else width)
    shaped: dict[str, Column] = {}
    if own:
        for i, name in enumerate(names):
            at = last_place(F.col(header), name)
            shaped[name] = _transform(transformers, name, i)(F.when(at.isNotNull(), F.coalesce(F.get(F.col("_cells"), at), F.lit(""))))
        for i in range(shortest, most):
            beyond = F.when(F.lit(i) >= F.size(header), cell(F.col("_cells"), i))
            shaped[f"column_{i}"] = F.coalesce(shaped[f"column_{i}"], beyond) if f"column_{i}" in shaped else beyond
    else:
        for i in range(most):
            name = fixed[i] if i < len(fixed) else f"column_{i}"
            shaped[name] = _transform(transformers if i < len(fixed) else None, name, i)(cell(F.col("_cells"), i))
    taken = {c.lower() for c in kept}
    return split.select(*kept, *[c.alias(_free(n, taken)) for n, c in shaped.items()])


def parse_documents(df: DataFrame, column: str, *, header: bool = True, mode: str = "array", delimiter: Delimiter = "\n", column_delimiter: Delimiter = COMMA, quotes: bool = False, crlf: bool = True, skip_empty: bool = True, drop: int = 0, take: int | None = None, names: list[str] | None = None, normalize_keys: bool | None = None, **options) -> DataFrame:
    """Rows whose ``column`` is a whole delimited document; the rows of all, numbered by ``pos``.

    The first record of each document is its header, for that document alone, and never counts for ``drop``
    and ``take``. Objects have the columns of all headers (one pass over them), or the columns ``names``,
    which then replace the headers, place by place.
    """
    d = parse_delimiter(column_delimiter)
    others = [c for c in df.columns if c not in (column, "pos")]
    all_records = records(F.col(column), delimiter, quotes=quotes, crlf=crlf, skip_empty=skip_empty)
    # The generator keeps the records from being made once for each of their uses.
    docs = df.select(*others, F.explode(F.array(all_records)).alias("_all"))
    own = header and names is None and mode != "array"
    if own:
        heads = F.coalesce(exprs.split_columns(F.get("_all", 0), d, quotes), F.array().cast("array<string>"))
        docs = docs.withColumn("_header", normalize_names_col(heads) if normalize_keys is not False else heads)
    first = max(drop, 0) + bool(header)
    rest = F.slice("_all", F.lit(first + 1), F.lit(2**31 - 1 - first if take is None else max(take, 0)))
    rows = docs.select(*others, *(["_header"] if own else []), F.posexplode(rest).alias("pos", "_row")).withColumn("pos", F.col("pos").cast("long"))
    if own and mode == "object" and options.get("ragged") != "map":
        options["names"] = name_union(docs.select("_header").distinct(), "_header")
    return parse_rows(rows, "_row", header="_header" if own else names, mode=mode, delimiter=column_delimiter, quotes=quotes, normalize_keys=normalize_keys, **options)
