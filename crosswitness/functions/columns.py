"""Schema-tolerant column access and record identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col_or_null(df: DataFrame, name: str, dtype: str = "string") -> Column:
    """The column, or a typed NULL when the table does not carry it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def text(c: Column) -> Column:
    """Cell as text with NULL rendered as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Twelve hex digits of md5 over the ``|``-joined cells, in column order."""
    names = columns or df.columns
    return F.substring(F.md5(F.concat_ws("|", *[text(F.col(c)) for c in names])), 1, 12)


def record_key(df: DataFrame, domain: str, columns: list[str] | None = None) -> Column:
    """Sequence number, else sponsor identifier, else the hash of the stored cells."""
    stored = [c for c in (columns or df.columns) if c != "scenario_id"]
    if f"{domain}SEQ" in stored:
        return F.col(f"{domain}SEQ").cast("bigint").cast("string")
    if f"{domain}SPID" in stored:
        return F.col(f"{domain}SPID").cast("string")
    return row_hash(df, stored)


def with_record_id(df: DataFrame, domain: str, columns: list[str] | None = None) -> DataFrame:
    """Add ``record_id`` = ``domain/subject/key``; trial-design rows use ``_trial_``."""
    who = F.col("USUBJID") if "USUBJID" in df.columns else F.lit("_trial_")
    return df.withColumn("record_id", F.concat_ws("/", F.lit(domain), who, record_key(df, domain, columns)))


def subject_of(record_id: Column) -> Column:
    """Subject segment of a record id."""
    return F.split(record_id, "/")[1]
