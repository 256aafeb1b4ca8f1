"""Zipping, merging and batching of DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linewright.session import materialise


def numbered(df: DataFrame, order: list, name: str = "idx") -> DataFrame:
    """``df`` with dense numbers from 0 in the given order, without a window over the whole table.

    Rows are dealt into ranges of the order; each range's rows are numbered on their own and moved
    up by the sizes of the ranges before it, of which there are as many as shuffle partitions. The
    ranges come from a sample, so the dealt rows are written once: both uses see the same ranges.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))  # one row for each range
    return local.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_start") + F.col("_n") - 1).cast("long")).drop("_part", "_n", "_start")


def zip_rows(a: DataFrame, b: DataFrame, order_a: list, order_b: list) -> DataFrame:
    """The rows of both side by side by their place, nulls where one is shorter, the place in ``idx``."""
    left, right = numbered(a, order_a), numbered(b, order_b)
    return left.join(right, "idx", "full_outer")


def zip_arrays(a: Column, b: Column) -> Column:
    """(a, b, idx) of two arrays, nulls where one is shorter."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("idx")))


def without_index(zipped: Column) -> Column:
    return F.transform(zipped, lambda s: F.struct(s["a"], s["b"]))


def merge(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, in no order."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def batch(df: DataFrame, pos: str, value: str, size: int, out: str = "items") -> DataFrame:
    """(batch, items): every ``size`` values in the order of the dense numbers ``pos``; the last batch may be shorter."""
    if size < 1:
        raise ValueError("a batch holds at least one item")
    items = F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda s: s[value])
    return df.groupBy(F.floor(F.col(pos) / size).cast("long").alias("batch")).agg(items.alias(out))
