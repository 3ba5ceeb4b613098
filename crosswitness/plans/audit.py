"""Tamper-evident log of flags.

Entries are linked by hashes inside short segments, one sequence of segments per subject,
so any number of segments can be written and verified in parallel.  ``seq`` is unique per
subject, hence a segment (``seq div SEGMENT``) never holds more than ``SEGMENT`` entries
however many flags a subject has.  Segment tips are then combined, a bounded number at a
time, into one digest per subject and one for the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswitness.functions.scalars import canonical_json
from crosswitness.operators.ordered import position
from crosswitness.operators.skew import Load

SEGMENT = 256
GENESIS = "genesis"

TRACE_COLUMNS = (
    "flag_id", "timestamp", "subject", "visit", "layer", "archetype", "severity", "evidence_path", "shape", "dag_node",
    "agent_trace", "core_rule_xref", "reviewer_label",
)


def flag_id() -> Column:
    """Deterministic id of a flag: digest of subject, rule and record."""
    return F.sha2(F.concat_ws("|", "subject", "rule_id", "record_id"), 256)


def to_traces(flags: DataFrame, run_time: str) -> DataFrame:
    """Flags as trace rows of one run; a repeated flag becomes one entry.

    The id is made of subject and rule, so copies share both, and flags that lie by subject are compared where they
    lie, in the order in which :func:`number` counts them.
    """
    return flags.select(
        flag_id().alias("flag_id"), F.lit(run_time).cast("timestamp").alias("timestamp"), "subject", "visit", "layer",
        "archetype", "severity", F.to_json("evidence").alias("evidence_path"), F.col("rule_id").alias("shape"),
        F.when(F.col("layer") == "L3", F.lit("compare_overall")).alias("dag_node"),
        F.when(F.col("layer") == "L3", F.to_json(F.map_from_entries(F.transform("evidence", lambda e: F.struct(e["type"], e["value"]))))).alias("agent_trace"),
        F.to_json("core_rule_xref").alias("core_rule_xref"), F.lit("pending").alias("reviewer_label"),
    ).dropDuplicates(["subject", "shape", "flag_id"])


def number(traces: DataFrame, load: Load | None = None) -> DataFrame:
    """Give each trace its position within the subject, ordered by shape and flag id.

    ``load`` is the measured size of the traces per subject; for a subject with very many
    flags the positions are counted per slice of the id space instead of in one sort.
    """
    slice_ = F.struct("shape", F.substring("flag_id", 1, 4))
    numbered = position(traces, ["subject"], [F.col("shape"), F.col("flag_id")], "seq", slice_, load)
    return numbered.withColumn("seq", F.col("seq").cast("bigint") - 1)


def payload(columns: tuple[str, ...] | list[str]) -> Column:
    return canonical_json({c: F.col(c) for c in columns})


def _segment_start() -> Column:
    return F.concat_ws("/", F.lit(GENESIS), "subject", F.col("segment").cast("string"))


def chain(entries: DataFrame, columns: tuple[str, ...] = TRACE_COLUMNS, segment: int = SEGMENT, open_tips: DataFrame | None = None) -> DataFrame:
    """Add ``segment``, ``prev_hash`` and ``entry_hash``.

    ``entries`` carries ``subject`` and a per-subject unique ``seq``.  The entry hash is the
    digest of the previous hash followed by the canonical JSON of the entry.  A segment that an
    earlier run began goes on from its entry in ``open_tips`` (subject, segment, tip).
    """
    rows = entries.withColumn("segment", F.floor(F.col("seq") / segment)).withColumn("_payload", payload(columns))
    stored = F.struct(*[F.col(c) for c in entries.columns])
    grouped = rows.groupBy("subject", "segment").agg(
        F.array_sort(F.collect_list(F.struct("seq", "_payload", stored.alias("row")))).alias("_rows"))

    def link(acc: Column, e: Column) -> Column:
        prev = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.sha2(F.concat(prev, e["_payload"]), 256)))

    start = _segment_start()
    if open_tips is not None:
        grouped = grouped.join(open_tips.select("subject", "segment", F.col("tip").alias("_tip")), ["subject", "segment"], "left")
        start = F.coalesce("_tip", start)
    hashes = F.aggregate("_rows", F.array(start), link)
    linked = grouped.withColumn("_h", hashes).select(
        "segment", "_h", F.posexplode("_rows").alias("_i", "_e"))
    return linked.select("_e.row.*", "segment", F.get("_h", F.col("_i")).alias("prev_hash"), F.get("_h", F.col("_i") + 1).alias("entry_hash"))


def broken_links(chained: DataFrame, columns: tuple[str, ...] = TRACE_COLUMNS) -> DataFrame:
    """Entries whose hash does not match their content or whose link does not match the entry before."""
    inside = Window.partitionBy("subject", "segment").orderBy("seq")
    expected_prev = F.coalesce(F.lag("entry_hash").over(inside), _segment_start())
    checked = chained.withColumn("_expected_prev", expected_prev).withColumn(
        "_expected_hash", F.sha2(F.concat(F.col("prev_hash"), payload(columns)), 256))
    return (checked.filter((F.col("prev_hash") != F.col("_expected_prev")) | (F.col("entry_hash") != F.col("_expected_hash")))
            .drop("_expected_prev", "_expected_hash"))


def tips(chained: DataFrame) -> DataFrame:
    """Last entry of every segment, with the number of entries."""
    return chained.groupBy("subject", "segment").agg(
        F.max_by("entry_hash", "seq").alias("tip"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("entries"))


def tip(chained: DataFrame) -> DataFrame:
    """Last entry of every subject."""
    return chained.groupBy("subject").agg(F.max_by("entry_hash", "seq").alias("tip"), F.count(F.lit(1)).alias("entries"))


def _combine(df: DataFrame, keys: list, order: str, digest: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(digest).alias("d"))))
    return df.groupBy(*keys).agg(F.sha2(F.concat_ws("|", F.transform(parts, lambda p: p["d"])), 256).alias(digest))


def seal(chained: DataFrame, *by: str) -> DataFrame:
    """One digest for the run, or for every value of ``by``.

    Tips fold up ``SEGMENT`` at a time per subject (three levels reach SEGMENT^4 entries),
    then subjects fold up by the leading digits of their own digest, so no step gathers
    more than a bounded group.
    """
    level = chained.groupBy(*by, "subject", F.col("segment").alias("_n")).agg(F.max_by("entry_hash", "seq").alias("digest"))
    for _ in range(3):
        level = _combine(level, [*by, "subject", F.floor(F.col("_n") / SEGMENT).alias("_m")], "_n", "digest").withColumnRenamed("_m", "_n")
    who = level.select(*by, "subject", "digest").withColumn("_k", F.sha2("subject", 256))
    for digits in (5, 4, 2):
        who = _combine(who, [*by, F.substring("_k", 1, digits).alias("_p")], "_k", "digest").withColumnRenamed("_p", "_k")
    return _combine(who.withColumn("_all", F.lit(1)), [*by, "_all"], "_k", "digest").select(*by, F.col("digest").alias("run_digest"))


def by_subject(chained: DataFrame, subject: str) -> DataFrame:
    return chained.filter(F.col("subject") == subject).orderBy("seq")


def by_archetype(chained: DataFrame, archetype: str) -> DataFrame:
    return chained.filter(F.col("archetype") == archetype).orderBy("subject", "seq")


# -- a log of several runs ---------------------------------------------------------------------------

def link_digests(digests: Column, start: Column) -> Column:
    """The digest of a log after runs with these seals, from the digest before them."""
    return F.aggregate(digests, start, lambda acc, d: F.sha2(F.concat_ws("|", acc, d), 256))


class ChainLog:
    """Runs appended to one chain.

    ``entries`` holds the linked entries, a folder per run.  ``tips`` holds per run the last
    entry of every subject the run touched; the next run goes on from the newest of them, in the
    open segment and with the next number.  ``runs`` holds a seal per run and the digest of
    the log up to it, so a run that was deleted or exchanged as a whole shows as well.
    """

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = TRACE_COLUMNS, segment: int = SEGMENT):
        self.spark, self.path, self.columns, self.segment = spark, path.rstrip("/"), columns, segment

    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def entries(self) -> DataFrame:
        return self._read("entries")

    def runs(self) -> DataFrame:
        """(run, run_id, seal, digest) in the order they were appended."""
        return self._read("runs")

    def _newest_tips(self, before: int) -> DataFrame | None:
        if before == 0:
            return None
        return self._read("tips").filter(F.col("run") < before).groupBy("subject").agg(
            F.max_by(F.struct("segment", "tip", "last_seq"), "run").alias("t")).select("subject", "t.*")

    def append(self, entries: DataFrame, run_id: str, order: list[str], load: Load | None = None, bucket: Column | None = None) -> int:
        """Number, link and store a run; the run's position.

        Repeating the newest run (after a failed write, say) replaces it; an older run id is refused.
        """
        stored = self.runs().select("run", "run_id").orderBy("run").collect() if self._exists("runs") else []  # a row a run
        run = next((r["run"] for r in stored if r["run_id"] == run_id), len(stored))
        if run < len(stored) - 1:
            raise ValueError(f"{run_id} is not the newest run")
        tips_ = self._newest_tips(run)
        rows = position(entries, ["subject"], [F.col(c) for c in order], "_n", bucket if bucket is not None else F.col(order[0]), load)
        if tips_ is None:
            rows = rows.withColumn("seq", F.col("_n") - 1)
        else:
            rows = rows.join(tips_.select("subject", "last_seq"), "subject", "left").withColumn("seq", F.coalesce("last_seq", F.lit(-1)) + F.col("_n")).drop("last_seq")
        linked = chain(rows.drop("_n"), self.columns, self.segment, tips_)
        where = {name: f"{self.path}/{name}/run={run}" for name in ("entries", "tips", "runs")}
        linked.write.mode("overwrite").parquet(where["entries"])
        linked = self.spark.read.schema(linked.schema).parquet(where["entries"])
        last = linked.groupBy("subject").agg(F.max_by(F.struct("segment", F.col("entry_hash").alias("tip"), F.col("seq").alias("last_seq")), "seq").alias("t"))
        last.select("subject", "t.*").write.mode("overwrite").parquet(where["tips"])
        before = self.runs().filter(F.col("run") == run - 1).first()["digest"] if run else GENESIS
        sealed = seal(linked).agg(F.coalesce(F.max("run_digest"), F.lit("")).alias("seal"))  # a run without entries has a seal too
        sealed.select(F.lit(run_id).alias("run_id"), "seal", link_digests(F.array("seal"), F.lit(before)).alias("digest")).write.mode("overwrite").parquet(where["runs"])
        return run

    def problems(self) -> DataFrame:
        """(problem, subject, run): broken links, missing numbers, and runs whose seal or digest does not fit."""
        entries, runs = self.entries(), self.runs()
        links = broken_links(entries, self.columns).select(F.lit("link").alias("problem"), "subject", "run")
        numbers = entries.groupBy("subject").agg(F.max("seq").alias("m"), F.count(F.lit(1)).alias("n"), F.max("run").alias("run"))
        gaps = numbers.filter(F.col("m") + 1 != F.col("n")).select(F.lit("number").alias("problem"), "subject", "run")
        tips_ = self._read("tips").groupBy("subject").agg(F.max("last_seq").alias("last"), F.max_by("run", "last_seq").alias("run"))
        short = tips_.join(numbers.select("subject", "m"), "subject", "left").filter(F.coalesce("m", F.lit(-1)) < F.col("last")).select(
            F.lit("tail").alias("problem"), "subject", "run")
        found = seal(entries, "run").withColumnRenamed("run_digest", "_seal")
        one = Window.orderBy("run")  # a row a run
        before = F.coalesce(F.lag("digest").over(one), F.lit(GENESIS))
        fits = (F.coalesce("_seal", F.lit("")) == F.col("seal")) & (F.sha2(F.concat_ws("|", before, "seal"), 256) == F.col("digest")) & (
            F.col("run") == F.row_number().over(one) - 1)
        chained = runs.join(found, "run", "left").withColumn("_fits", fits)
        wrong = chained.filter("NOT _fits").select(F.lit("run").alias("problem"), F.lit(None).cast("string").alias("subject"), "run")
        return links.unionByName(gaps).unionByName(short).unionByName(wrong)

    def consistent(self, early: str, late: str) -> bool:
        """Does the log with digest ``late`` contain the log with digest ``early`` as its beginning?

        The proof is the list of seals in between, one a run.
        """
        runs = [r.asDict() for r in self.runs().orderBy("run").collect()]
        at = {r["digest"]: n for n, r in enumerate(runs)}
        if early not in at or late not in at or at[early] > at[late]:
            return False
        seals = [r["seal"] for r in runs[at[early] + 1 : at[late] + 1]]
        joined = self.spark.range(1).select(link_digests(F.array(*map(F.lit, seals)).cast("array<string>"), F.lit(early)).alias("d"))
        return joined.first()["d"] == late
