"""Order-dependent values (previous row, running minimum, position) per group.

While the measured groups fit a task these are ordinary windows.  For larger groups the
order is cut into consecutive buckets: a window runs inside each bucket, the buckets are
summarised to one row each, the summaries are carried forward, and the carried value is
joined back.  No task then holds more than one bucket of one group.  NULL keys, orders and
buckets are groups like any other on either path; NULLs come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswitness.operators.skew import Load
from crosswitness.sources.staging import written

VISITS_PER_BUCKET = 1_000


def visit_bucket(order: str = "VISITNUM") -> Column:
    return F.floor(F.col(order) / VISITS_PER_BUCKET)


def _plain(load: Load | None) -> bool:
    return load is None or not load.hot


def _carried(df: DataFrame, carry: DataFrame, on: list[str]) -> DataFrame:
    """Every row with its bucket's carried value; NULL keys and buckets match each other."""
    right = carry.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in carry.columns if c not in on])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return df.join(right, match).drop(*[f"_on_{c}" for c in on])


def previous(df: DataFrame, keys: list[str], order: str, value: str, out: str,
             load: Load | None = None, bucket: Column | None = None) -> DataFrame:
    """``out`` = ``value`` of the preceding row (NULLs are not skipped).

    Rows must be unique on ``keys + [order]``.
    """
    if _plain(load):
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))
    df = df.withColumn("_b", visit_bucket(order) if bucket is None else bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    last = df.groupBy(*keys, "_b").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(F.col(order).isNotNull(), F.col(order))).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b"))).drop("_last")
    here = df.withColumn("_n", F.row_number().over(inside)).withColumn("_lag", F.lag(value).over(inside))
    return (
        _carried(here, carry, [*keys, "_b"])
        .withColumn(out, F.when(F.col("_n") > 1, F.col("_lag")).otherwise(F.col("_carry.v")))
        .drop("_b", "_n", "_lag", "_carry")
    )


def running_min(df: DataFrame, keys: list[str], order: str, value: str, out: str,
                load: Load | None = None, bucket: Column | None = None) -> DataFrame:
    """``out`` = minimum of ``value`` from the first row up to and including this one."""
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if _plain(load):
        return df.withColumn(out, F.min(value).over(rows(Window.partitionBy(*keys).orderBy(order))))
    df = df.withColumn("_b", visit_bucket(order) if bucket is None else bucket)
    low = df.groupBy(*keys, "_b").agg(F.min(value).alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = low.withColumn("_carry", F.min("_low").over(before)).drop("_low")
    here = df.withColumn("_in", F.min(value).over(rows(Window.partitionBy(*keys, "_b").orderBy(order))))
    return (
        _carried(here, carry, [*keys, "_b"])
        .withColumn(out, F.least("_in", "_carry"))
        .drop("_b", "_in", "_carry")
    )


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
               load: Load | None = None, bucket: Column | None = None) -> DataFrame:
    """``out`` = the newest ``value`` that is not NULL, up to and including this row; ``bucket`` must not decrease along ``order``."""
    rows = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if _plain(load):
        return df.withColumn(out, F.last(value, ignorenulls=True).over(rows(Window.partitionBy(*keys).orderBy(*order))))
    df = df.withColumn("_b", bucket)
    newest = df.groupBy(*keys, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_newest"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = newest.withColumn("_carry", F.last("_newest", ignorenulls=True).over(before)).drop("_newest")
    here = df.withColumn("_in", F.last(value, ignorenulls=True).over(rows(Window.partitionBy(*keys, "_b").orderBy(*order))))
    return _carried(here, carry, [*keys, "_b"]).withColumn(out, F.coalesce("_in", "_carry")).drop("_b", "_in", "_carry")


def position(df: DataFrame, keys: list[str], order: list[Column], out: str, bucket: Column,
             load: Load | None = None) -> DataFrame:
    """``out`` = 1-based position (bigint); ``bucket`` must not decrease along ``order``."""
    if _plain(load):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    df = df.withColumn("_b", bucket)
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (
        _carried(df.withColumn("_n", F.row_number().over(inside)), offset, [*keys, "_b"])
        .withColumn(out, F.col("_n") + F.col("_offset"))
        .drop("_b", "_n", "_offset")
    )


def numbered(df: DataFrame, keys: list[str], order: list[Column], out: str, path: str, partitions: int | None = None) -> DataFrame:
    """``out`` = 1-based position (bigint) per key, or over the whole table without keys, by range partitioning.

    Rows are dealt over ranges of (keys, order) and sorted inside each, so neither a key nor one
    value of the order has to fit a task; ties, full copies among them, are cut by their place in
    the input.  The ranges are written under ``path``, since a second evaluation could cut them
    elsewhere.  A key then starts at its first row of a range, and counts of earlier ranges are
    added: one small row per (range, key), of which a key has at most as many as there are ranges.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    by = [*[F.col(k).asc() for k in keys], *order, F.col("_tie").asc()]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, path).withColumn("_range", F.shiftright("_at", 33))  # the partition is in the upper bits
    sizes = ranged.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    return (_carried(ranged, starts, [*keys, "_range"]).withColumn(out, F.col("_at") - F.col("_first") + 1 + F.col("_before"))
            .drop("_at", "_range", "_first", "_before"))
