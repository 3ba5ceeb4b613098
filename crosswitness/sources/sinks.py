"""Writers: domain tables, flags and the trace log."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswitness.sources.study import Study


def write_study(study: Study, path: str, fmt: str = "parquet", concurrent: int = 4) -> None:
    """One folder per domain; several are made and written at a time, so small ones fill gaps that large ones leave."""
    def write(domain: str) -> None:
        writer = study.tables[domain].write.mode("overwrite")
        (writer.option("header", True).csv(f"{path}/{domain}.csv") if fmt == "csv" else writer.format(fmt).save(f"{path}/{domain}"))

    # the measurements are the largest, and the responses' sums can be taken from them
    order = sorted(study.tables, key=lambda d: d != "TR")
    with ThreadPoolExecutor(concurrent) as pool:
        list(pool.map(write, order))


def write_sorted(df: DataFrame, domain: str, path: str, partitions: int = 8) -> None:
    """Range-partitioned, sorted domain: files are in order and so are the rows in them."""
    order = [c for c in ("USUBJID", "VISITNUM", f"{domain}SEQ") if c in df.columns]
    out = df.select(F.lit(domain).alias("DOMAIN"), *[c for c in df.columns if c != "DOMAIN"])
    out.repartitionByRange(partitions, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_traces(traces: DataFrame, path: str, run_id: str) -> DataFrame:
    """Append traces of a run and return those refused because their flag id is known.

    New ids are decided by an anti join against the log's id column only.  The run is its
    own partition and replaces itself, so a repeated write of the same run adds nothing.
    """
    spark = traces.sparkSession
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    exists = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)
    fresh = traces.dropDuplicates(["flag_id"])
    refused = traces.limit(0)
    if exists:
        known = spark.read.parquet(path).filter(F.col("run_id") != run_id).select("flag_id")
        refused = traces.join(known, "flag_id", "left_semi")
        fresh = fresh.join(known, "flag_id", "left_anti")
    fresh.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    return refused
