"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the digest of the normalised text.  A batch is
reduced to one row per digest before its shuffle, anti-joined with the index by sort-merge
(the index side is read in its bucket order, without a shuffle), and the new digests are
appended.  Texts that an earlier batch brought stay represented by that batch; within a batch
the row with the largest id stays.

The number of buckets is stored beside the index, since an index read with another number would
miss digests; opening adopts it.  An index row names its batch: a batch brought again under another
name keeps nothing, and one repeated under its own name (after a failed run) keeps what it kept.

Defined results: a null text counts as empty; a null id is smaller than every id; of rows that
repeat id and text one stays; an empty batch adds nothing; other columns are never read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.llm.common import ascii_lower, only, table, work_folder, write_table

#: A digest held by more than this share of a batch is joined by broadcast; there are at most as many as its inverse.
HOT_SHARE = 1 / 2000


class DigestIndex:
    """The digests seen so far, in a bucketed table at ``path``; opening an existing path continues it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._stored_buckets(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, keep_batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/index'"
        )

    def _stored_buckets(self, wanted: int) -> int:
        """The number of buckets that the index was made with; a new index is made with the wanted one."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/layout/_SUCCESS")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            self.spark.range(1).selectExpr(f"{wanted} AS buckets").write.mode("overwrite").parquet(f"{self.path}/layout")
        return int(self.spark.read.parquet(f"{self.path}/layout").first()["buckets"])

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def digests(self, batch: DataFrame, batch_name: str, text: str = "text", id: str = "doc_id") -> DataFrame:
        """One narrow row per input row, written so that every later step sees the same row numbers."""
        rows = only(batch, doc_id=id, text=text)
        return write_table(rows.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(ascii_lower(F.col("text")), 256)).alias("digest"),
        ), f"{self.path}/{batch_name}/digests")

    def ingest(self, batch: DataFrame, batch_name: str, text: str = "text", id: str = "doc_id") -> DataFrame:
        """Append the batch's new texts; return one row per input row with the row that stays for its text.

        Columns: doc_id, keep_id, group_size (rows of this batch with the text), kept, digest.
        """
        rows = self.digests(batch, batch_name, text, id)
        groups = write_table(rows.groupBy("digest").agg(
            F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"),
        ).select("digest", F.col("last.doc_id").alias("doc_id"), F.col("last.row").alias("row"), "group_size"),
            f"{self.path}/{batch_name}/groups")
        known = self.table().select("digest", F.col("keep_id").alias("known_id"))
        fresh = groups.join(known.hint("merge"), "digest", "left_anti")
        (fresh.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(batch_name).alias("keep_batch"))
         .repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name))
        merged = groups.join(self.table().hint("merge"), "digest").select(
            "digest", "keep_id", "group_size",
            F.when(F.col("keep_batch") == batch_name, F.col("keep_row")).alias("keep_row"))  # rows of other batches may have the same number
        found = write_table(merged, f"{self.path}/{batch_name}/found")
        limit = int(rows.count() * HOT_SHARE)
        hot = F.broadcast(found.where(F.col("group_size") > limit))  # at most 1 / HOT_SHARE rows
        out = ("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), "digest")
        of_hot = rows.join(hot, "digest").select(*out)
        rest = rows.join(hot.select("digest"), "digest", "left_anti")
        return of_hot.unionByName(rest.join(found.where(F.col("group_size") <= limit), "digest").select(*out))


def kept_rows(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Every document with the document that stays for its text; the query's columns."""
    found = DigestIndex(spark, path or work_folder(spark)).ingest(docs, "batch-0")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_rows(spark, table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, text_sha256
FROM d WINDOW t AS (PARTITION BY text_sha256)
"""
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
SQL = {"op1_exact_dedup": OP1_SQL}
