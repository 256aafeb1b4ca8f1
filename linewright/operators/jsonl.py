"""JSON Lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_json_rows(rows: DataFrame, value: str = "value", *, schema: str | None = None, pos: str | None = "pos", out: str = "json") -> DataFrame:
    """``rows`` with ``value`` parsed into ``out``: VARIANT, or ``schema``. The first bad row fails the query and says its number."""
    text = F.col(value)
    number = F.col(pos).cast("string") if pos and pos in rows.columns else F.lit("?")
    failed = F.raise_error(F.concat(F.lit("Failed to parse JSON at row "), number))
    variant = F.try_parse_json(text)
    parsed: Column = variant if schema is None else F.from_json(text, schema, {"mode": "FAILFAST"})
    good = F.when(variant.isNull() & text.isNotNull(), failed.cast(schema if schema else "variant")).otherwise(parsed)
    return rows.select(*[c for c in rows.columns if c not in (value, out)], good.alias(out))


def to_json_rows(df: DataFrame, *columns: str, out: str = "value") -> DataFrame:
    """One JSON object for each row, with its nulls."""
    names = columns or df.columns
    return df.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias(out))
