"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.llm import byte_bpe, decontaminate, line_dedup, near_dedup, toxicity
from crosswitness.llm.common import free_name, table, work_folder, write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; the lexicon is fitted on the labelled ones."""
    return toxicity.accepted(spark, docs, table(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines whose template recurs across documents; n_chars follows the text."""
    out = line_dedup.deduplicated(spark, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup.kept_rows(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lie in benchmark passages."""
    return decontaminate.clean_rows(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their token ids and the text decoded from these."""
    decoded = free_name(docs, "decoded")
    out = byte_bpe.round_trip(spark, docs)
    return out.withColumn(decoded, F.col(decoded).cast("string"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line-dedup", drop_recurring_lines),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-bpe", encode),
]
#: Mined lexicons, signatures and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs, root = table(spark, sf_dir, "documents"), work_folder(spark)
    for at, (name, stage) in enumerate(STAGES):
        docs = write_table(stage(spark, docs, sf_dir), f"{root}/{at}-{name}")
    return docs
