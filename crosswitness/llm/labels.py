"""A bounded sample of labelled rows for fitting, chosen by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswitness.llm.common import only

#: Most labelled rows that a classifier is fitted on; scoring always covers every row.
SAMPLE = 20_000


def fold(id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; a null id is in fold 0."""
    return F.coalesce(F.crc32(id.cast("string")) % mod, F.lit(0))


def sample(labels: DataFrame, label: str, usable: Column, bound: int = SAMPLE) -> DataFrame:
    """At most ``bound`` rows (doc_id, y) with a label; of contradicting repeated labels the larger counts."""
    rows = only(labels, doc_id="doc_id", y=label).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & usable)
    rows = rows.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
