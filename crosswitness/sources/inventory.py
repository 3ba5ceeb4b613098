"""What is in a folder: column inventories and integrity manifests."""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.sources.study import Study


def column_inventory(study: Study, study_id: str) -> DataFrame:
    """Study, dataset, rows, column, type and label of every column.

    Row counts come from file footers (no column is read); columns come from the schema.
    """
    parts = []
    for domain, df in sorted(study.tables.items()):
        cols = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                                  F.lit(f.metadata.get("label", "")).alias("label")) for f in df.schema.fields])
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(study_id).alias("study"), F.lit(domain).alias("dataset"), "n_rows", F.inline(cols)))
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Bytes of a file up to which it is read as one row.
WHOLE = 32_000_000
#: No file that is read in lines is cut into several partitions (64 TiB); lines to a batch, and bytes.
UNCUT = {"spark.sql.files.maxPartitionBytes": str(1 << 46), "spark.sql.files.openCostInBytes": str(1 << 46),
         "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
BOM = b"\xef\xbb\xbf"


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """sha256 and size of every file under the path.

    The hash of a file is sequential, so one task reads it.  Files beyond ``WHOLE`` are not held: they are hashed
    at once, as they are read, in a job each.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    whole = files.filter(F.col("length") <= WHOLE).select(name, "path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > WHOLE).select(name, "path", "length").collect()
    if not large:
        return whole
    uncut = spark.newSession()
    for key, value in UNCUT.items():
        uncut.conf.set(key, value)
    with ThreadPoolExecutor(8) as pool:
        digests = list(pool.map(lambda r: _streamed(uncut, r["path"], r["length"]), large))
    rows = [(*r, digest) for r, digest in zip(large, digests, strict=True)]
    return whole.unionByName(spark.createDataFrame(rows, whole.schema))


def _streamed(uncut: SparkSession, path: str, length: int) -> str:
    """sha256 of a file that no process holds as a whole: a task reads its lines, of any bytes, and hashes them one after the other.

    The reader skips a byte order mark, so it is looked at here.  A file that the reader would unpack by its name is
    hashed from the driver's stream.
    """
    jvm, conf = uncut._jvm, uncut._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    try:
        if jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at) is not None:
            return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        head = bytes(x for x in (stream.read() for _ in BOM) if x >= 0)
    finally:
        stream.close()
    head = head if head == BOM else b""

    def digest(batches):
        total, size, first = hashlib.sha256(head), len(head), True
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                part = (b"" if first else b"\n") + b"\n".join(lines)
                total.update(part)
                size, first = size + len(part), False
        if size + 1 == length and not first:  # the last line ends
            total.update(b"\n")
            size += 1
        if not first or not length:
            yield pa.RecordBatch.from_pydict({"sha256": [total.hexdigest()], "size": [size]})

    literal = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
    lines = uncut.read.option("lineSep", "\n").text(literal).select(F.col("value").cast("binary"))
    found = lines.mapInArrow(digest, "sha256 string, size bigint").collect()
    if len(found) != 1 or found[0]["size"] != length:
        raise ValueError(f"{path}: read {[r['size'] for r in found]} bytes of {length}; did the file change?")
    return found[0]["sha256"]


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed."""
    both = expected.select("file", F.col("sha256").alias("expected")).join(
        actual.select("file", F.col("sha256").alias("actual")), "file", "full_outer")
    status = (F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected")
              .when(F.col("actual") != F.col("expected"), "changed"))
    return both.withColumn("status", status).filter("status IS NOT NULL").select("file", "status")


def with_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Attach column labels as metadata."""
    return df.select(*[F.col(c).alias(c, metadata={"label": labels[c]}) if c in labels else F.col(c) for c in df.columns])
