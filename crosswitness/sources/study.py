"""The study: one DataFrame per domain, with canonical columns filled in as NULL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.functions.columns import col_or_null
from crosswitness.operators.skew import ROWS_PER_TASK, Load, measure

# Tells a quoted empty CSV cell (an empty text) from an unquoted one (no value).
QUOTED_EMPTY = "\u0001"

DOMAINS = ("DM", "EX", "TU", "TR", "RS", "AE", "DS", "TA", "SUPPDM")

# Canonical columns of the domains.
SCHEMAS = {
    "DM": "STUDYID string, USUBJID string, AGE double, AGEU string, AGETXT string, SEX string, RACE string, "
          "ETHNIC string, ARM string, ARMCD string, ARMNRS string, ACTARM string, ACTARMCD string, "
          "RFSTDTC string, RFENDTC string, RFXSTDTC string, RFXENDTC string, RFICDTC string, DTHFL string, "
          "DTHDTC string",
    "EX": "STUDYID string, USUBJID string, EXSEQ double, EXTRT string, EXDOSE double, EXSTDTC string, "
          "EXENDTC string, EPOCH string",
    "AE": "STUDYID string, USUBJID string, AESEQ double, AETERM string, AEDECOD string, AETOXGR string, "
          "AESEV string, AESTDTC string, AEREL string, EPOCH string",
    "DS": "STUDYID string, USUBJID string, DSSEQ double, DSDECOD string, DSCAT string, DSTERM string, "
          "DSSTDTC string, EPOCH string",
    "TA": "STUDYID string, ARMCD string, ARM string, TAETORD double, ETCD string, ELEMENT string, TASEQ double",
    "TU": "STUDYID string, USUBJID string, VISITNUM double, TUSEQ double, TULNKID string, TUCAT string, "
          "TULOC string, TUTESTCD string",
    "TR": "STUDYID string, USUBJID string, VISITNUM double, TRSEQ double, TRLNKID string, TRGRPID string, "
          "TRTESTCD string, TRSTRESN double, TRORRES string, TRSTAT string, TRDTC string, EPOCH string, "
          "TRTARGETLN boolean",
    "RS": "STUDYID string, USUBJID string, VISITNUM double, RSSEQ double, RSCAT string, RSTESTCD string, "
          "RSORRES string, RSSTRESC string, RSSTRESN double, RSDTC string, EPOCH string",
    "SUPPDM": "STUDYID string, RDOMAIN string, USUBJID string, IDVAR string, IDVARVAL string, QNAM string, "
              "QLABEL string, QVAL string, QORIG string, QEVAL string",
    "RELREC": "RDOMAIN string, USUBJID string, IDVAR string, IDVARVAL string, RELTYPE string, RELID string",
}


def columns_of(domain: str) -> dict[str, str]:
    pairs = [p.split() for p in SCHEMAS[domain].split(",")]
    return {name: dtype for name, dtype in pairs}


class Deferred(Mapping):
    """Named values of which each is made once, when it is first asked for, and then kept; several may be made at a time."""

    def __init__(self, makers: dict[str, Callable]):
        self._makers, self._made, self._begun = makers, {}, set()
        self._locks = {name: RLock() for name in makers}

    def __getitem__(self, name: str):
        with self._locks[name]:
            if name not in self._made:
                self._begun.add(name)
                self._made[name] = self._makers[name]()
            return self._made[name]

    def begun(self, name: str) -> bool:
        """Is the value made, or being made?"""
        return name in self._begun

    def get(self, name: str, default=None):
        return self[name] if name in self._makers else default

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def with_values(old: Mapping, new: Mapping) -> Mapping:
    """``old`` with the values of ``new`` over its own; what ``old`` has not made yet is not made for it."""
    if not isinstance(old, Deferred):
        return {**old, **new}
    return Deferred({**{k: lambda k=k: old[k] for k in old}, **{k: lambda v=v: v for k, v in new.items()}})


@dataclass(frozen=True)
class Study:
    """Domain tables plus the columns that identify a subject.

    ``keys`` grows by ``scenario_id`` when several injected copies of a cohort are checked
    in one job.  Tables that no scenario changes need no copies: they are named in ``shared``
    and stay keyed by subject, and ``scenarios`` lists the (scenario_id, USUBJID) in play.
    ``loads`` holds measured group sizes (see :mod:`operators.skew`).  ``buckets`` tells over how
    many buckets of subjects the tables are written (0: they are not).  ``facts`` holds facts that
    are made already, with the tables they were made from: (tables, rows) by name.
    """

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    keys: tuple[str, ...] = ("USUBJID",)
    loads: Mapping[str, Load] = field(default_factory=dict)
    shared: frozenset[str] = frozenset()
    scenarios: DataFrame | None = None
    buckets: int = 0
    facts: Mapping[str, tuple[frozenset[str], DataFrame]] = field(default_factory=dict)

    def seen_from(self, *domains: str) -> "Study":
        """The study for a fact over these tables: without scenarios where all of them are shared."""
        if not self.shared.intersection(domains):
            return self
        if not self.shared.issuperset(domains):
            raise ValueError(f"of {domains} some are shared between scenarios and some are not")
        return replace(self, keys=tuple(k for k in self.keys if k != "scenario_id"), shared=frozenset(), scenarios=None, facts={})

    @property
    def scope(self) -> tuple[str, ...]:
        """Key columns other than the subject."""
        return tuple(k for k in self.keys if k != "USUBJID")

    def raw(self, domain: str) -> DataFrame | None:
        return self.tables.get(domain)

    def __getitem__(self, domain: str) -> DataFrame:
        """The domain with every canonical column present; empty when it is missing."""
        df = self.tables.get(domain)
        if df is None:
            ddl = SCHEMAS[domain] + "".join(f", {k} string" for k in self.scope)
            return self.spark.createDataFrame([], ddl)
        missing = {c: t for c, t in columns_of(domain).items() if c not in df.columns}
        target = missing.pop("TRTARGETLN", None)
        df = df.withColumns({c: F.lit(None).cast(t) for c, t in missing.items()}) if missing else df
        if target:
            df = target_flag(df)
        return df

    def _facts_without(self, *domains: str) -> Mapping[str, tuple[frozenset[str], DataFrame]]:
        return {name: made for name, made in self.facts.items() if not made[0].intersection(domains)}

    def with_tables(self, **tables: DataFrame) -> "Study":
        return replace(self, tables=with_values(self.tables, tables), facts=self._facts_without(*tables))

    def with_made(self, domain: str, make: Callable[[], DataFrame]) -> "Study":
        """As :meth:`with_tables`; where tables are made on demand, so is this one."""
        if not isinstance(self.tables, Deferred):
            return self.with_tables(**{domain: make()})
        others = {d: lambda d=d: self.tables[d] for d in self.tables}
        return replace(self, tables=Deferred({**others, domain: make}), facts=self._facts_without(domain))

    def by_subject(self, domain: str) -> bool:
        """Has the table subjects?  One that is not made yet is taken to have its canonical columns."""
        if isinstance(self.tables, Deferred) and domain in SCHEMAS:
            return "USUBJID" in columns_of(domain)
        return "USUBJID" in self.tables[domain].columns

    def load(self, name: str) -> Load | None:
        return self.loads.get(name)

    def measured(self, rows_per_task: int = ROWS_PER_TASK) -> "Study":
        """Measure every domain by subject, and DM by arm, in one job; shared ones are not keyed by scenario."""
        own = {d: self.tables[d] for d in self.tables if d not in self.shared}
        wanted = {d: (df, self.keys) for d, df in own.items() if set(self.keys) <= set(df.columns)}
        dm = own.get("DM")
        if dm is not None and {*self.scope, "ARMCD"} <= set(dm.columns):
            wanted["DM by ARMCD"] = (dm, (*self.scope, "ARMCD"))
        if self.scenarios is not None:
            wanted["scenarios"] = (self.scenarios, ("USUBJID",))
        return replace(self, loads=with_values(self.loads, measure(wanted, rows_per_task)))

    def measured_on_demand(self, rows_per_task: int = ROWS_PER_TASK) -> "Study":
        """As :meth:`measured`, but a domain is measured when its size is first asked for."""
        size = lambda d, keys: (lambda: measure({d: (self.tables[d], keys)}, rows_per_task)[d])
        sizes = {d: size(d, self.keys) for d in self.tables if self.by_subject(d)}
        by_arm = lambda: measure({"DM": (self.tables["DM"], (*self.scope, "ARMCD"))}, rows_per_task)["DM"]
        return replace(self, loads=Deferred({**sizes, "DM by ARMCD": by_arm}))

    def staged(self, path: str, buckets: int = 0, name: str = "study") -> "Study":
        """Write every domain once and read it back.

        Later checks then scan narrow column subsets instead of recomputing the inputs, and
        a lost executor only re-reads files.  With ``buckets`` the subject tables are
        bucketed by subject, so subject-keyed aggregates and joins need no shuffle; skip
        that for a study with a hot subject, whose rows would all land in one bucket.  The
        bucketed tables get names of their own per call, so no table of the catalogue is replaced.
        """
        unique = f"{name}_{uuid.uuid4().hex[:12]}"

        def write(item: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
            domain, df = item
            where = f"{path}/{domain}"
            if buckets and "USUBJID" in df.columns and not (self.load(domain) and self.load(domain).hot):
                table = f"{unique}_{domain}".lower()
                (df.repartition(buckets, "USUBJID").write.mode("overwrite").bucketBy(buckets, "USUBJID")
                 .sortBy("USUBJID").option("path", where).saveAsTable(table))
                return domain, self.spark.table(table)
            df.write.mode("overwrite").parquet(where)
            return domain, self.spark.read.parquet(where)

        with ThreadPoolExecutor(4) as pool:  # several small writes share the cluster
            out = dict(pool.map(write, self.tables.items()))
        return replace(self, tables=out)


def target_flag(df: DataFrame) -> DataFrame:
    """TRTARGETLN from the lesion group."""
    return df.withColumn("TRTARGETLN", F.upper(col_or_null(df, "TRGRPID")) == "TARGET")


def _stem(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].split(".")[0].upper()


def list_tables(spark: SparkSession, *paths: str) -> dict[str, tuple[str, str]]:
    """``{DOMAIN: (location, format)}`` of the tables under the paths; first path wins.

    Uses the Hadoop file system of each path, so it works on any store Spark can read.
    """
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    found: dict[str, tuple[str, str]] = {}
    for path in paths:
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(conf)
        names = sorted(s.getPath().toString() for s in fs.listStatus(root))
        here: dict[str, tuple[str, str]] = {}
        for name in names:
            leaf = name.rstrip("/").rsplit("/", 1)[-1]
            if leaf.startswith(("_", ".")):
                continue
            ext = leaf.rsplit(".", 1)[-1].lower() if "." in leaf else "parquet"
            if ext in ("parquet", "csv", "json", "orc"):
                here.setdefault(_stem(leaf), (name, ext))
        for domain, where in here.items():
            found.setdefault(domain, where)
    return found


def load_study(spark: SparkSession, *paths: str, domains: tuple[str, ...] | None = DOMAINS + ("RELREC",)) -> Study:
    """Open the domain tables found under the paths.

    Only requested domains are opened (``domains=None`` opens all); when several paths
    hold the same domain the first path wins and the others are not read.  CSV cells are
    read as text and cast to the canonical types.
    """
    tables = {}
    for domain, (location, ext) in list_tables(spark, *paths).items():
        if domains is not None and domain not in domains:
            continue
        reader = spark.read
        if ext == "csv":
            df = reader.option("header", True).option("emptyValue", QUOTED_EMPTY).csv(location)
            types = columns_of(domain) if domain in SCHEMAS else {}
            text = {c: F.when(F.col(c) == QUOTED_EMPTY, "").otherwise(F.col(c)) for c in df.columns}
            df = df.select(*[v.try_cast(types.get(c, "string")).alias(c) for c, v in text.items()])
        else:
            df = reader.format(ext).load(location)
        tables[domain] = df
    return Study(spark, tables)
