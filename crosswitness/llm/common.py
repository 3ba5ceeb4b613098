"""What the operators of this subpackage share: folding, words, tables, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.sources.staging import staging_root

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Everything between words, after A-Z are lower-cased.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, for written intermediates."""
    root = staging_root(spark)
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root


def write_table(df: DataFrame, path: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends, and the planner knows the size."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty.

    Pure ASCII texts take ``lower``, which is the same there and much faster than ``translate``.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def words(lowered: Column) -> Column:
    """The words of a lower-cased text, in order."""
    return F.array_remove(F.split(lowered, BETWEEN_WORDS), "")


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once per row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not use."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that extra columns cannot clash."""
    return df.select(*[df[f"`{c}`"].alias(new) for new, c in columns.items()])
