"""Joins against one-row-per-key tables that survive a key holding a third of the rows.

A table is measured once (two numbers per grouping: rows, and rows of the largest
group).  While the largest group fits one task, joins and windows stay plain.  Beyond
that, rows of hot keys are never shuffled: they stay in the partitions they were read
into and meet a broadcast copy of the few fact rows of the hot keys, while all other
rows take the ordinary shuffle join.  At most ``MAX_HOT_KEYS`` keys can exceed the limit,
because the limit is never below ``rows / MAX_HOT_KEYS``; that bounds what is broadcast.
Full copies of one row are spread as well, since nothing depends on a row's content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000_000
MAX_HOT_KEYS = 20_000


@dataclass(frozen=True)
class Load:
    """Measured size of a table under one grouping."""

    rows: int
    largest: int
    rows_per_task: int = ROWS_PER_TASK

    @property
    def limit(self) -> int:
        return max(self.rows_per_task, -(-self.rows // MAX_HOT_KEYS))

    @property
    def hot(self) -> bool:
        return self.largest > self.limit


def measure(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], rows_per_task: int = ROWS_PER_TASK) -> dict[str, Load]:
    """Rows and largest group of several (table, key) pairs in one job.

    Only the key columns are read; a table that lies by its key is counted where it lies, the
    counts of any other are combined map-side; one row per pair comes back to the driver.
    """
    parts = [
        df.groupBy(*keys).count().agg(F.lit(name).alias("name"), F.sum("count").alias("rows"), F.max("count").alias("largest"))
        for name, (df, keys) in tables.items()
    ]
    if not parts:
        return {}
    sizes = parts[0]
    for p in parts[1:]:
        sizes = sizes.unionAll(p)
    sizes = sizes.filter("rows IS NOT NULL")
    found = {r["name"]: Load(r["rows"], r["largest"], rows_per_task) for r in sizes.collect()}
    return {name: found.get(name, Load(0, 0, rows_per_task)) for name in tables}


def keyed_join(left: DataFrame, facts: DataFrame, on: list[str], how: str = "left", load: Load | None = None) -> DataFrame:
    """Equi-join with a table holding at most one row per ``on``.

    ``load`` describes ``left`` under ``on`` or under a subset of it (such a group is never
    smaller than its sub-groups, so it is a safe stand-in).
    """
    if load is None or not load.hot:
        return left.join(facts, on, how)
    hot = left.groupBy(*on).count().filter(F.col("count") > load.limit).select(*on)
    # At most rows / limit <= MAX_HOT_KEYS keys pass the filter and facts are unique on the
    # key, so both broadcasts below are bounded by MAX_HOT_KEYS rows.
    hot_facts = F.broadcast(facts.join(F.broadcast(hot), on, "left_semi"))
    hot_rows = left.join(F.broadcast(hot), on, "left_semi").join(hot_facts, on, how)
    other_rows = left.join(F.broadcast(hot), on, "left_anti").join(facts, on, how)
    return other_rows.unionByName(hot_rows)


def pair_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner",
              loads: tuple[Load, Load] | None = None) -> DataFrame:
    """Many-to-many equi-join (inner or left) in which no task meets more than about ``limit`` pairs of one key.

    ``loads`` are the measured sizes of both sides under ``on``.  A key is hot when it has more
    than sqrt(limit) rows on either side, again never less than rows / MAX_HOT_KEYS.  The rows
    of a hot key form a grid of a x b cells: left rows are dealt over a strips and repeated in
    all b columns, right rows the other way round, and every pair meets in exactly one cell.
    The side with more rows is dealt finer, so with few rows on the other side b is 1 and only
    the small side is repeated.  All other keys, NULL among them, take the ordinary join.

    Rows are dealt by their position in their partition, so copies of a row spread as well;
    both sides should come from files, whose positions a repeated task finds again.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no many-to-many join of kind {how}")
    if loads is None or loads[0].largest * loads[1].largest <= min(x.rows_per_task for x in loads):
        return left.join(right, on, how)
    pairs = min(x.rows_per_task for x in loads)
    side = max(1, int(pairs ** 0.5))
    least = [max(side, -(-x.rows // MAX_HOT_KEYS)) for x in loads]
    heavy = [df.groupBy(*on).count().filter(F.col("count") > n).select(*on) for df, n in zip((left, right), least)]
    # At most rows / least <= MAX_HOT_KEYS keys of each side; everything broadcast below has one row a key.
    hot = F.broadcast(heavy[0].unionByName(heavy[1]).distinct())
    counts = [df.join(hot, on, "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias(name)) for df, name in ((left, "_l"), (right, "_r"))]
    columns = F.greatest(F.lit(1), F.ceil(F.coalesce("_r", F.lit(0)) / side))
    strips = F.greatest(F.lit(1), F.ceil(F.col("_l") * F.ceil(F.coalesce("_r", F.lit(0)) / columns) / pairs))
    grid = F.broadcast(counts[0].join(counts[1], on, "left").select(*on, strips.alias("_a"), columns.alias("_b"), F.col("_r").isNull().alias("_alone")))

    def dealt(df: DataFrame, dealt_over: str, repeated_in: str) -> DataFrame:
        mine, other = ("_i", "_j") if dealt_over == "_a" else ("_j", "_i")
        return (df.join(grid, on).withColumn(mine, F.monotonically_increasing_id() % F.col(dealt_over))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(repeated_in) - 1))))

    l_hot, r_hot = dealt(left, "_a", "_b"), dealt(right, "_b", "_a").drop("_a", "_b", "_alone")
    met = l_hot.drop("_a", "_b", "_alone").join(r_hot, [*on, "_i", "_j"]).drop("_i", "_j")
    out = left.join(hot, on, "left_anti").join(right, on, how).unionByName(met)
    if how == "left":
        alone = left.join(grid.filter("_alone").select(*on), on, "left_semi")
        out = out.unionByName(alone, allowMissingColumns=True)
    return out
