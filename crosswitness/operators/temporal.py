"""Joins of two tables on time: all pairs within some days, and the newest earlier row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswitness.operators.ordered import last_known
from crosswitness.operators.skew import ROWS_PER_TASK, measure, pair_join


def within_days(left: DataFrame, right: DataFrame, on: list[str], left_day: Column, right_day: Column, days: int,
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """All pairs with equal keys whose dates differ by at most ``days``; rows without a date have none.

    Time is cut into buckets of ``days`` + 1 days, so a partner is in the same bucket or in one beside it: the
    right side is repeated for three buckets and the join becomes an equality, which a busy day
    of one key survives as any other hot key does.  The exact distance is tested afterwards.
    """
    width = days + 1
    day = lambda d: F.datediff(d.cast("date"), F.lit("1970-01-01").cast("date"))
    l_side = left.withColumn("_day", day(left_day)).filter("_day IS NOT NULL").withColumn("_bucket", F.floor(F.col("_day") / width))
    r_side = right.withColumn("_other", day(right_day)).filter("_other IS NOT NULL").withColumn(
        "_bucket", F.explode(F.array(*[F.floor(F.col("_other") / width) + i for i in (-1, 0, 1)])))
    keys = [*on, "_bucket"]
    found = measure({"l": (l_side, tuple(keys)), "r": (r_side, tuple(keys))}, rows_per_task)
    met = pair_join(l_side, r_side, keys, loads=(found["l"], found["r"]))
    return met.filter(F.abs(F.col("_day") - F.col("_other")) <= days).drop("_day", "_other", "_bucket")


def newest_before(left: DataFrame, right: DataFrame, on: list[str], left_day: Column, right_day: Column, take: list[str],
                  tie: str, out: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``out`` = struct of the columns ``take`` of the newest right row that is not after the left row, or NULL.

    Both sides are put in one order (right rows first on the same date, the largest ``tie`` last)
    and the last right row seen is carried forward, so no pairs are formed.  A key with very many
    rows is cut into months, and only one value a month is carried between them.
    """
    names = left.columns
    rows = left.select(F.struct(*names).alias("_row"), *on, left_day.cast("date").alias("_day"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"))
    seen = F.struct(*take)
    both = rows.withColumn("_seen", F.lit(None).cast(right.select(seen.alias("s")).schema["s"].dataType)).unionByName(
        right.filter(right_day.cast("date").isNotNull()).select(
            F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *on, right_day.cast("date").alias("_day"), F.lit(0).alias("_side"),
            F.col(tie).alias("_tie"), seen.alias("_seen")))
    load = measure({"both": (both, tuple(on))}, rows_per_task)["both"]
    month = F.coalesce(F.year("_day") * 12 + F.month("_day"), F.lit(-1))  # rows without a date come first and see nothing
    carried = last_known(both, on, ["_day", "_side", "_tie"], "_seen", out, load, month)
    return carried.filter("_side = 1").select("_row.*", out)
