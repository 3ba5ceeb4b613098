"""Sources, sinks, mapping jobs and the audit trail over the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from crosswitness.catalog.check_queries import ALL, flags_cte
from crosswitness.catalog.testbed import PRELUDE, study, table
from crosswitness.plans import audit, mapping
from crosswitness.plans.checks import run_checks, write_flags
from crosswitness.sources import inventory, issues, sinks
from crosswitness.operators.skew import measure
from crosswitness.sources.staging import required_root, staging_root
from crosswitness.sources.study import list_tables, load_study
from crosswitness.functions.columns import with_record_id

Q: dict = {}
O: dict = {}


def query(name: str, sql: str = ""):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = sql
        return fn
    return add


NAMES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


# -- sources ------------------------------------------------------------------------------
@query("SRC01", " UNION ALL ".join(f"SELECT '{n.upper()}' AS domain, count(*) AS n FROM {n}" for n in ("customer", "orders", "lineitem")))
def _(spark, sf):
    st = load_study(spark, sf, domains=("CUSTOMER", "ORDERS", "LINEITEM"))
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(d).alias("domain"), "n") for d, df in sorted(st.tables.items())]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("SRC02", " UNION ALL ".join(f"SELECT '{n.upper()}' AS domain, '{n}.parquet' AS file, count(*) AS n FROM {n}" for n in NAMES))
def _(spark, sf):
    found = list_tables(spark, sf)
    out = None
    for domain, (where, _fmt) in sorted(found.items()):
        part = spark.read.parquet(where).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(domain).alias("domain"), F.lit(where.rsplit("/", 1)[-1]).alias("file"), "n")
        out = part if out is None else out.unionAll(part)
    return out


@query("SRC04", "SELECT 'orders' AS taken, count(*) AS n FROM orders")
def _(spark, sf):
    # the same domain offered twice: the first location wins, the second is never opened
    st = load_study(spark, sf, sf, domains=("ORDERS",))
    return st.tables["ORDERS"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("orders").alias("taken"), "n")


@query("SRC05", PRELUDE + "SELECT concat('RS/', USUBJID, '/', CAST(RSSEQ AS VARCHAR)) AS record_id, USUBJID, VISITNUM, RSTESTCD, RSORRES FROM rs")
def _(spark, sf):
    return with_record_id(study(spark, sf).raw("RS"), "RS").select("record_id", "USUBJID", "VISITNUM", "RSTESTCD", "RSORRES")


@query("SRC06", PRELUDE + "SELECT RELID, count(*) AS n, count(DISTINCT RDOMAIN) AS domains FROM relrec GROUP BY ALL")
def _(spark, sf):
    return study(spark, sf)["RELREC"].groupBy("RELID").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("RDOMAIN").alias("domains"))


ISSUES = """WITH issue AS (
  SELECT CASE o_orderkey % 7 WHEN 0 THEN 'dm.xpt' WHEN 1 THEN 'EX.xpt' WHEN 2 THEN 'lb.xpt' WHEN 3 THEN 'rs.xpt' WHEN 4 THEN 'vs.xpt' WHEN 5 THEN 'tu.xpt' ELSE 'tr.xpt' END AS dataset,
    CASE WHEN o_orderkey % 11 <> 0 THEN concat('S', CAST(o_custkey AS VARCHAR)) END AS USUBJID, concat('CORE-', CAST(o_orderkey % 50 AS VARCHAR)) AS core_id,
    CASE WHEN o_orderkey % 13 = 0 THEN 'Rule FAILED to build' ELSE concat('Priority ', o_orderpriority) END AS message,
    o_orderstatus AS variables, CAST(o_orderkey % 5 AS VARCHAR) AS "values", o_orderkey % 3 = 0 AS late FROM orders)
"""


REPORT_ROWS = 10_000  # order keys are unique, so a report never holds more issues than this


def _issues(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.element_at(F.array(*map(F.lit, ("dm.xpt", "EX.xpt", "lb.xpt", "rs.xpt", "vs.xpt", "tu.xpt", "tr.xpt"))), (k % 7 + 1).cast("int")).alias("dataset"),
        F.when(k % 11 != 0, F.concat(F.lit("S"), F.col("o_custkey").cast("string"))).alias("USUBJID"),
        F.concat(F.lit("CORE-"), (k % 50).cast("string")).alias("core_id"),
        F.when(k % 13 == 0, "Rule FAILED to build").otherwise(F.concat(F.lit("Priority "), F.col("o_orderpriority"))).alias("message"),
        F.col("o_orderstatus").alias("variables"), (k % 5).cast("string").alias("values"), (k % 3 == 0).alias("late"),
        F.floor(k / REPORT_ROWS).alias("report"))


@query("SRC07", ISSUES + """SELECT coalesce(USUBJID, '') AS subject, core_id AS rule_id, upper(split_part(dataset, '.', 1)) AS domain, 'violation' AS severity, message, 'CORE' AS source
  FROM issue WHERE lower(dataset) IN ('dm.xpt', 'ex.xpt', 'tu.xpt', 'tr.xpt', 'rs.xpt')""")
def _(spark, sf):
    # the issues pass through JSON report files, as a validator would leave them
    rows = _issues(spark, sf).drop("late")
    names = [c for c in rows.columns if c != "report"]
    root = required_root(spark)
    report = rows.groupBy("report").agg(F.collect_list(F.struct(*names)).alias("Issue_Details")).drop("report")
    report.write.mode("overwrite").option("maxRecordsPerFile", 1).json(f"{root}/issues")  # one report a file
    rows = issues.load_issues(spark, f"{root}/issues")
    return issues.to_flags(rows.select(*names), "CORE").drop("archetype")


@query("SRC08", """SELECT n_name AS domain, CAST(n_regionkey AS VARCHAR) AS variables, '' AS "values", concat('R', CAST(n_nationkey AS VARCHAR)) AS rule_id,
  concat('About ', n_name) AS message, '' AS category, 'Error' AS severity FROM nation WHERE n_nationkey <> 7""")
def _(spark, sf):
    raw = table(spark, sf, "nation").select(
        F.col("n_name").alias("Domain"), F.col("n_regionkey").alias("Variables"),
        F.when(F.col("n_nationkey") == 7, "DD0101").otherwise(F.concat(F.lit("R"), F.col("n_nationkey").cast("string"))).alias("Rule ID"),
        F.concat(F.lit("About "), "n_name").alias("Message"), F.lit("Error").alias("Severity"))
    return issues.clean_report_rows(raw)


@query("SRC09", ISSUES + "SELECT dataset, USUBJID, core_id, message FROM issue WHERE NOT contains(lower(message), 'failed to build')")
def _(spark, sf):
    return issues.real_issues(_issues(spark, sf)).select("dataset", "USUBJID", "core_id", "message")


@query("J10", ISSUES + """SELECT a.core_id, a.dataset, a.USUBJID, a.message FROM issue a WHERE a.late AND NOT EXISTS (SELECT 1 FROM issue b WHERE NOT b.late
  AND b.core_id = a.core_id AND b.dataset = a.dataset AND b.USUBJID IS NOT DISTINCT FROM a.USUBJID AND b.variables = a.variables AND b."values" = a."values"
  AND left(b.message, 120) = left(a.message, 120))""")
def _(spark, sf):
    rows = _issues(spark, sf)
    return issues.new_issues(rows.filter("late"), rows.filter("NOT late")).select("core_id", "dataset", "USUBJID", "message")


@query("SRC10", PRELUDE + "SELECT 'ST' AS study, d AS dataset, n AS n_rows, c AS \"column\" FROM (" + " UNION ALL ".join(
    f"SELECT '{d}' AS d, unnest({c}) AS c, (SELECT count(*) FROM {d.lower()}) AS n" for d, c in (
        ("EX", "['USUBJID', 'EXSEQ', 'EXTRT', 'EXDOSE', 'EXSTDTC', 'EXENDTC']"), ("DS", "['USUBJID', 'DSDECOD']"), ("TA", "['ARMCD', 'ARM']"))) + ")")
def _(spark, sf):
    st = study(spark, sf)
    few = type(st)(spark, {d: st.tables[d] for d in ("EX", "DS", "TA")})
    return inventory.column_inventory(few, "ST").select("study", "dataset", "n_rows", "column")


TEN = ("AE", "DM", "DS", "EX", "RELREC", "RS", "SUPPDM", "TA", "TR", "TU")


@query("SRC10-ALL", PRELUDE + " UNION ALL ".join(
    f"SELECT 'ST' AS study, '{d}' AS dataset, (SELECT count(*) FROM {d.lower()}) AS n_rows, column_name AS \"column\" FROM (DESCRIBE SELECT * FROM {d.lower()})" for d in TEN))
def _(spark, sf):
    return inventory.column_inventory(study(spark, sf), "ST").select("study", "dataset", "n_rows", "column")


@query("SRC11")
def _(spark, sf):
    return inventory.manifest(spark, sf, "*.parquet").select("file", "length", "sha256").orderBy("file")


# -- sinks ------------------------------------------------------------------------------------
SUBJECT_TABLES = ("AE", "DM", "DS", "EX", "RELREC", "RS", "SUPPDM", "TR", "TU")


@query("SNK01", PRELUDE + " UNION ALL ".join(
    [f"SELECT '{d}' AS domain, count(*) AS n, count(DISTINCT USUBJID) AS subjects FROM {d.lower()}" for d in SUBJECT_TABLES]
    + ["SELECT 'TA', count(*), CAST(0 AS BIGINT) FROM ta"]))
def _(spark, sf):
    st = study(spark, sf)
    root = required_root(spark)
    sinks.write_study(st, f"{root}/sink", "csv")
    st = load_study(spark, f"{root}/sink")
    who = lambda d: F.countDistinct("USUBJID") if d in SUBJECT_TABLES else F.lit(0).cast("bigint")
    parts = [st[d].agg(F.count(F.lit(1)).alias("n"), who(d).alias("subjects")).select(F.lit(d).alias("domain"), "n", "subjects") for d in (*SUBJECT_TABLES, "TA")]
    return reduce(lambda x, y: x.unionAll(y), parts)


@query("SNK02", PRELUDE + "SELECT 'RS' AS DOMAIN, USUBJID, VISITNUM, RSSEQ, RSTESTCD, RSORRES FROM rs")
def _(spark, sf):
    rs = study(spark, sf).raw("RS").select("USUBJID", "VISITNUM", "RSSEQ", "RSTESTCD", "RSORRES")
    root = required_root(spark)
    sinks.write_sorted(rs, "RS", f"{root}/sorted")
    return spark.read.parquet(f"{root}/sorted")


@query("SNK03", PRELUDE + flags_cte(["A06", "A08"]) + "SELECT subject, rule_id, record_id FROM flags")
def _(spark, sf):
    flags = run_checks(study(spark, sf), ["A06", "A08"]).select("subject", "rule_id", "record_id")
    root = required_root(spark)
    sinks.write_json(flags, f"{root}/flags")
    return spark.read.schema("subject string, rule_id string, record_id string").json(f"{root}/flags")


TRACES = PRELUDE + flags_cte(["A06", "A18"])


@query("SNK04", TRACES + """SELECT sha256(concat_ws('|', subject, rule_id, record_id)) AS flag_id, subject, rule_id AS shape,
  CASE rule_id WHEN 'A06' THEN 'run-1' ELSE 'run-2' END AS run_id FROM flags""")
def _(spark, sf):
    st = study(spark, sf)
    first = audit.to_traces(run_checks(st, ["A06"]), "2025-01-01 00:00:00")
    both = audit.to_traces(run_checks(st, ["A06", "A18"]), "2025-01-02 00:00:00")
    root = required_root(spark)
    sinks.append_traces(first, f"{root}/traces", "run-1")
    sinks.append_traces(both, f"{root}/traces", "run-2")
    log = spark.read.parquet(f"{root}/traces")
    return log.select("flag_id", "subject", "shape", "run_id")


# -- audit ----------------------------------------------------------------------------------------
SEG = 2000
AUDIT = f"""WITH RECURSIVE e AS (
  SELECT concat('U', CAST(user_id AS VARCHAR)) AS subject, event_id AS seq, event_id // {SEG} AS segment,
    concat('{{"archetype":"', event_type, '","seq":', CAST(event_id AS VARCHAR), '}}') AS body FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY subject, segment ORDER BY seq) AS n FROM e),
ch AS (SELECT subject, segment, seq, n, concat_ws('/', 'genesis', subject, CAST(segment AS VARCHAR)) AS prev_hash,
    sha256(concat(concat_ws('/', 'genesis', subject, CAST(segment AS VARCHAR)), body)) AS entry_hash FROM r WHERE n = 1
  UNION ALL SELECT r.subject, r.segment, r.seq, r.n, ch.entry_hash, sha256(concat(ch.entry_hash, r.body))
  FROM ch JOIN r ON r.subject = ch.subject AND r.segment = ch.segment AND r.n = ch.n + 1)
"""
BODY = ("archetype", "seq")


def _entries(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("subject"), F.col("event_id").alias("seq"), F.col("event_type").alias("archetype"))


def _chained(spark, sf):
    return audit.chain(_entries(spark, sf), BODY, SEG)


@query("AU01", "SELECT event_id AS seq, sha256(concat('genesis{\"archetype\":\"', event_type, '\",\"seq\":', CAST(event_id AS VARCHAR), '}')) AS h FROM events")
def _(spark, sf):
    return _entries(spark, sf).select("seq", F.sha2(F.concat(F.lit(audit.GENESIS), audit.payload(BODY)), 256).alias("h"))


@query("AU02", AUDIT + "SELECT subject, segment, seq, prev_hash, entry_hash FROM ch")
def _(spark, sf):
    return _chained(spark, sf).select("subject", "segment", "seq", "prev_hash", "entry_hash")


@query("AU03", "SELECT 0 AS broken, count(*) AS entries FROM events")
def _(spark, sf):
    chained = _chained(spark, sf)
    bad = audit.broken_links(chained, BODY).agg(F.count(F.lit(1)).alias("broken")).withColumn("_k", F.lit(1))
    n = chained.agg(F.count(F.lit(1)).alias("entries")).withColumn("_k", F.lit(1))
    return bad.join(n, "_k").select(F.col("broken").cast("int").alias("broken"), "entries")


@query("AU04", AUDIT + "SELECT subject, arg_max(entry_hash, seq) AS tip, count(*) AS entries FROM ch GROUP BY subject")
def _(spark, sf):
    return audit.tip(_chained(spark, sf))


@query("AU05", "SELECT concat('U', CAST(user_id AS VARCHAR)) AS subject, event_id AS seq FROM events WHERE event_type = 'signup'")
def _(spark, sf):
    # every signup entry is altered after the fact; the log reports exactly those
    chained = _chained(spark, sf)
    forged = chained.withColumn("seq_kept", F.col("seq")).withColumn(
        "archetype", F.when(F.col("archetype") == "signup", "purchase").otherwise(F.col("archetype")))
    return audit.broken_links(forged, BODY).select("subject", "seq")


SEAL = ", ".join(
    ["t0 AS (SELECT subject, segment AS n, arg_max(entry_hash, seq) AS d FROM ch GROUP BY ALL)"]
    + [f"t{i} AS (SELECT subject, n // 256 AS n, sha256(string_agg(d, '|' ORDER BY n)) AS d FROM t{i - 1} GROUP BY subject, n // 256)" for i in (1, 2, 3)]
    + ["w0 AS (SELECT sha256(subject) AS k, d FROM t3)"]
    + [f"w{i} AS (SELECT substr(k, 1, {digits}) AS k, sha256(string_agg(d, '|' ORDER BY k)) AS d FROM w{i - 1} GROUP BY substr(k, 1, {digits}))" for i, digits in enumerate((5, 4, 2), 1)])


@query("AU-SEAL", AUDIT + f", {SEAL} SELECT sha256(string_agg(d, '|' ORDER BY k)) AS run_digest FROM w3")
def _(spark, sf):
    return audit.seal(_chained(spark, sf))


TWO_RUNS = """WITH RECURSIVE e AS (SELECT concat('U', CAST(user_id AS VARCHAR)) AS subject, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS run FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY run, event_id) - 1 AS seq FROM e),
r AS (SELECT subject, run, seq, seq // 64 AS segment, concat('{"archetype":"', event_type, '","event_id":', CAST(event_id AS VARCHAR), ',"seq":', CAST(seq AS VARCHAR), '}') AS body FROM k),
ch AS (SELECT subject, run, segment, seq, sha256(concat(concat_ws('/', 'genesis', subject, CAST(segment AS VARCHAR)), body)) AS entry_hash FROM r WHERE seq % 64 = 0
  UNION ALL SELECT r.subject, r.run, r.segment, r.seq, sha256(concat(ch.entry_hash, r.body)) FROM ch JOIN r ON r.subject = ch.subject AND r.segment = ch.segment AND r.seq = ch.seq + 1)
"""


def _two_runs(spark, sf):
    """Every third event is logged by a first run, the others by a second that goes on from its tips."""
    log = audit.ChainLog(spark, f"{required_root(spark)}/log", ("archetype", "event_id", "seq"), 64)
    e = table(spark, sf, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("subject"), "event_id", F.col("event_type").alias("archetype"))
    early = F.col("event_id") % 3 == 0
    load = measure({"e": (e, ("subject",))})["e"]
    for name, rows in (("first", e.filter(early)), ("second", e.filter(~early))):
        log.append(rows, name, ["event_id"], load, F.floor(F.col("event_id") / 1000))
    return log


@query("AU-RUNS", TWO_RUNS + "SELECT subject, seq, run, entry_hash FROM ch")
def _(spark, sf):
    return _two_runs(spark, sf).entries().select("subject", "seq", F.col("run").cast("int").alias("run"), "entry_hash")


@query("AU-CHECK", "SELECT count(*) AS entries, count(DISTINCT user_id) AS subjects, 2 AS runs, 0 AS problems, TRUE AS consistent FROM events")
def _(spark, sf):
    log = _two_runs(spark, sf)
    first, last = (r["digest"] for r in log.runs().orderBy("run").collect())
    proved = log.consistent(first, last) and not log.consistent(last, first)
    bad = log.problems().agg(F.count(F.lit(1)).cast("int").alias("problems"))
    return log.entries().agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("subject").alias("subjects")).join(F.broadcast(bad), F.lit(True)).select(
        "entries", "subjects", F.lit(2).alias("runs"), "problems", F.lit(proved).alias("consistent"))


@query("AU-FLAGS", PRELUDE + flags_cte() + """SELECT subject, rule_id AS shape, sha256(concat_ws('|', subject, rule_id, record_id)) AS flag_id,
  row_number() OVER (PARTITION BY subject ORDER BY rule_id, sha256(concat_ws('|', subject, rule_id, record_id))) - 1 AS seq FROM flags""")
def _(spark, sf):
    st, root = study(spark, sf), staging_root(spark)
    # with a folder to write to, a job per group of checks: one task then holds the sorts of one group only
    flags = write_flags(st, f"{root}/flags", ALL) if root else run_checks(st, ALL)
    traces = audit.to_traces(flags, "2025-01-01 00:00:00")
    return audit.chain(audit.number(traces)).select("subject", "shape", "flag_id", "seq")


@query("T02", AUDIT + "SELECT subject, segment, arg_max(entry_hash, seq) AS tip FROM ch GROUP BY subject, segment")
def _(spark, sf):
    return audit.tips(_chained(spark, sf)).select("subject", "segment", "tip")


@query("W07", AUDIT + "SELECT subject, segment, seq, prev_hash = lag(entry_hash) OVER (PARTITION BY subject, segment ORDER BY seq) AS linked FROM ch QUALIFY n > 1")
def _(spark, sf):
    from pyspark.sql import Window
    inside = Window.partitionBy("subject", "segment").orderBy("seq")  # at most SEG entries each
    return (_chained(spark, sf).withColumn("_before", F.lag("entry_hash").over(inside)).filter("_before IS NOT NULL")
            .select("subject", "segment", "seq", (F.col("prev_hash") == F.col("_before")).alias("linked")))


# -- mapping ------------------------------------------------------------------------------------------
FORM1 = """WITH lesles AS (
  SELECT CAST(o_custkey AS VARCHAR) AS PT, CAST(o_orderkey % 6 AS DOUBLE) AS VISITNUM,
    CASE WHEN l_linenumber = 7 THEN ' ' WHEN l_linenumber <= 4 THEN concat('T', CAST(l_linenumber AS VARCHAR)) ELSE concat('NT', CAST(l_linenumber AS VARCHAR)) END AS LESID,
    CASE WHEN l_linenumber <= 4 AND l_quantity > 3 THEN l_quantity END AS LNGDIA, CASE WHEN l_linenumber = 7 THEN l_quantity * 2 END AS DIASUM,
    l_linestatus AS LESSIT, l_returnflag AS LESEVL, CASE WHEN l_quantity <= 3 THEN 'Not done' ELSE '' END AS NDONE
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
rsp AS (SELECT CAST(o_custkey AS VARCHAR) AS PT, CAST(o_orderkey % 6 AS DOUBLE) AS VISITNUM, CASE o_orderkey % 4 WHEN 0 THEN 'PR' WHEN 1 THEN 'SD' WHEN 2 THEN '' ELSE 'PD' END AS TRSP,
    CASE WHEN o_orderkey % 5 = 0 THEN 'CR' END AS NTRSP, CASE o_orderkey % 3 WHEN 0 THEN ' SD ' WHEN 1 THEN 'PD' ELSE '' END AS ORSP FROM orders),
rdm AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN concat('X', CAST(c_custkey AS VARCHAR)) ELSE CAST(c_custkey AS VARCHAR) END AS PT, CAST(c_custkey % 80 AS DOUBLE) AS AGE, 'F' AS SEX, 'WHITE' AS RACE,
    CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('Arm ', c_mktsegment) END AS TRTP FROM customer),
rds AS (SELECT CAST(c_custkey AS VARCHAR) AS PT, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS DSDECOD, 'EVENT' AS DSCAT, 'END' AS EPOCH FROM customer)
"""


def _form1(spark, sf):
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    k, n, q = F.col("o_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
    who, visit = F.col("o_custkey").cast("string").alias("PT"), (k % 6).cast("double").alias("VISITNUM")
    lesles = li.withColumnRenamed("l_orderkey", "o_orderkey").join(o.select("o_orderkey", "o_custkey"), "o_orderkey").select(
        who, visit, F.when(n == 7, " ").otherwise(F.concat(F.when(n <= 4, "T").otherwise("NT"), n.cast("string"))).alias("LESID"),
        F.when((n <= 4) & (q > 3), q).alias("LNGDIA"), F.when(n == 7, q * 2).alias("DIASUM"), F.col("l_linestatus").alias("LESSIT"),
        F.col("l_returnflag").alias("LESEVL"), F.when(q <= 3, "Not done").otherwise("").alias("NDONE"))
    rsp = o.select(who, visit, F.when(k % 4 == 0, "PR").when(k % 4 == 1, "SD").when(k % 4 == 2, "").otherwise("PD").alias("TRSP"),
                   F.when(k % 5 == 0, "CR").alias("NTRSP"), F.when(k % 3 == 0, " SD ").when(k % 3 == 1, "PD").otherwise("").alias("ORSP"))
    c = table(spark, sf, "customer")
    ck = F.col("c_custkey")
    dm = c.select(F.when(ck % 9 == 0, F.concat(F.lit("X"), ck.cast("string"))).otherwise(ck.cast("string")).alias("PT"), (ck % 80).cast("double").alias("AGE"),
                  F.lit("F").alias("SEX"), F.lit("WHITE").alias("RACE"), F.when(ck % 10 != 0, F.concat(F.lit("Arm "), "c_mktsegment")).alias("TRTP"))
    ds = c.select(ck.cast("string").alias("PT"), F.when(ck % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("DSDECOD"), F.lit("EVENT").alias("DSCAT"), F.lit("END").alias("EPOCH"))
    return mapping.map_lesion_form({"lesles": lesles, "rsp": rsp, "dm": dm, "ds": ds}, mapping.TrialConfig("ST1"), measured=True)


FIRST_TU = """SELECT 'ST1' AS STUDYID, concat('ST1-', PT) AS USUBJID, v AS VISITNUM, CAST(row_number() OVER (PARTITION BY PT ORDER BY v, LESID) AS DOUBLE) AS TUSEQ, LESID AS TULNKID,
  CASE WHEN LESID LIKE 'NT%' THEN 'NON-TARGET LESION' ELSE 'TARGET LESION' END AS TUCAT, loc AS TULOC
  FROM (SELECT PT, LESID, min(VISITNUM) AS v, arg_min(LESSIT, struct_pack(a := VISITNUM, b := LESSIT)) AS loc FROM lesles WHERE trim(LESID) <> '' GROUP BY ALL)"""


@query("M01", FORM1 + FIRST_TU)
def _(spark, sf):
    return _form1(spark, sf)["TU"].drop("TUTESTCD")


@query("M02", FORM1 + """SELECT concat('ST1-', PT) AS USUBJID, VISITNUM, LESID AS TRLNKID, CASE WHEN LESID LIKE 'NT%' THEN 'NON-TARGET' ELSE 'TARGET' END AS TRGRPID,
  CASE WHEN LESID LIKE 'NT%' THEN 'TUMSTATE' ELSE 'LDIAM' END AS TRTESTCD, CASE WHEN LESID LIKE 'T%' THEN LNGDIA END AS TRSTRESN,
  CASE WHEN LESID LIKE 'NT%' THEN LESEVL ELSE coalesce(CAST(LNGDIA AS VARCHAR), '') END AS TRORRES, CASE WHEN NDONE = 'Not done' THEN 'NOT DONE' ELSE '' END AS TRSTAT,
  CASE WHEN VISITNUM = 0 THEN 'SCREENING' ELSE 'TREATMENT' END AS EPOCH FROM lesles WHERE trim(LESID) <> ''""")
def _(spark, sf):
    return _form1(spark, sf).raw("TR").drop("STUDYID", "TRSEQ")


@query("M03", FORM1 + """, s AS (SELECT PT, VISITNUM, coalesce(max(CASE WHEN trim(LESID) = '' THEN DIASUM END), sum(CASE WHEN LESID LIKE 'T%' THEN LNGDIA END)) AS x FROM lesles GROUP BY ALL),
  u AS (SELECT PT, VISITNUM, 1 AS n, 'TARGET RESPONSE' AS RSCAT, 'OVRESP' AS RSTESTCD, trim(TRSP) AS RSORRES, NULL AS RSSTRESN FROM rsp WHERE trim(TRSP) <> ''
    UNION ALL SELECT PT, VISITNUM, 2, 'NON-TARGET RESPONSE', 'NTRGRESP', trim(NTRSP), NULL FROM rsp WHERE trim(NTRSP) <> ''
    UNION ALL SELECT PT, VISITNUM, 3, 'OVERALL RESPONSE', 'OVRLRESP', trim(ORSP), NULL FROM rsp WHERE trim(ORSP) <> ''
    UNION ALL SELECT PT, VISITNUM, 4, 'TARGET RESPONSE', 'SUMDIAM', '', x FROM s WHERE x IS NOT NULL)
  SELECT concat('ST1-', PT) AS USUBJID, VISITNUM, CAST(row_number() OVER (PARTITION BY PT ORDER BY VISITNUM, n, RSORRES, RSSTRESN) AS DOUBLE) AS RSSEQ, RSCAT, RSTESTCD, RSORRES, RSSTRESN,
    CASE WHEN VISITNUM = 0 THEN 'SCREENING' ELSE 'TREATMENT' END AS EPOCH FROM u""")
def _(spark, sf):
    return _form1(spark, sf).raw("RS").drop("STUDYID", "RSSTRESC")


M04 = FORM1 + """SELECT concat('ST1-', PT) AS USUBJID, AGE, coalesce(TRTP, '') AS ARM, replace(upper(left(coalesce(TRTP, ''), 8)), ' ', '') AS ARMCD FROM rdm"""


@query("M04", M04)
def _(spark, sf):
    return _form1(spark, sf).raw("DM").select("USUBJID", "AGE", "ARM", "ARMCD")


@query("M04-TA", FORM1 + """SELECT replace(upper(left(TRTP, 8)), ' ', '') AS ARMCD, TRTP AS ARM, CAST(n AS DOUBLE) AS TASEQ, concat('EL0', CAST(n AS VARCHAR)) AS ETCD
  FROM (SELECT TRTP, row_number() OVER (ORDER BY TRTP) AS n FROM (SELECT DISTINCT TRTP FROM rdm WHERE TRTP IS NOT NULL))""")
def _(spark, sf):
    return _form1(spark, sf).raw("TA").select("ARMCD", "ARM", "TASEQ", "ETCD")


@query("M04-DS", FORM1 + "SELECT concat('ST1-', PT) AS USUBJID, 1.0::DOUBLE AS DSSEQ, DSDECOD, DSCAT, EPOCH FROM rds WHERE trim(DSDECOD) <> ''")
def _(spark, sf):
    return _form1(spark, sf).raw("DS").drop("STUDYID")


FORM2 = """WITH lesions AS (
  SELECT CAST(o_custkey AS DOUBLE) AS RSUBJ_ID, CAST(o_orderkey % 4 + 1 AS DOUBLE) AS VISIT_ID, CASE WHEN l_linenumber <= 4 THEN 'Target lesion' ELSE 'Non-target' END AS LESTYPE,
    CASE WHEN l_linenumber < 7 THEN CAST(l_linenumber AS DOUBLE) END AS LESNUM, l_linestatus AS LESLOC, CASE WHEN l_linenumber <= 4 AND l_quantity > 3 THEN l_quantity END AS TGTSIZE,
    CASE l_returnflag WHEN 'R' THEN 'Disappeared' WHEN 'A' THEN 'Cannot be seen' ELSE 'Stable' END AS QUAN, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(o_orderkey % 400 AS DOUBLE) END AS EXAMDAY
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
responses AS (SELECT CAST(o_custkey AS DOUBLE) AS RSUBJ_ID, CAST(o_orderkey % 4 + 1 AS DOUBLE) AS VISIT_ID, CAST(o_orderkey % 400 AS DOUBLE) AS EXAMDAY,
    CASE o_orderkey % 4 WHEN 0 THEN 'pr' WHEN 1 THEN 'SD' WHEN 2 THEN '{---}' ELSE 'PD' END AS TGTRESP, CASE WHEN o_orderkey % 5 = 0 THEN 'CR' END AS NTGTRESP,
    CASE o_orderkey % 3 WHEN 0 THEN 'SD' ELSE 'XX' END AS ALLRESP, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice END AS SUMTGT FROM orders),
demo AS (SELECT CAST(c_custkey AS DOUBLE) AS RSUBJ_ID, CAST(c_custkey % 80 AS DOUBLE) AS AGE, CAST(c_custkey % 4 AS VARCHAR) AS RACE_GEN, CASE WHEN c_custkey % 3 = 0 THEN 'A' ELSE ' ' END AS ELIG_007 FROM customer),
eosr AS (SELECT CAST(c_custkey AS DOUBLE) AS RSUBJ_ID, CAST(c_custkey % 3 AS VARCHAR) AS EOSR_003, c_mktsegment AS EOSR_004, CAST(c_custkey % 700 AS DOUBLE) AS EOSRDAY_001 FROM customer),
toxy AS (SELECT CAST(user_id AS DOUBLE) AS RSUBJ_ID, CAST(event_id AS DOUBLE) AS TOXYDAY_000, CAST(event_id % 5 AS VARCHAR) AS TOXY_001, 'U' AS TOXY_002, CASE WHEN event_type = 'click' THEN '2' END AS TOXY_003,
    '0' AS TOXY_004, CAST(event_id % 3 AS VARCHAR) AS TOXY_005, '' AS TOXY_006 FROM events),
dose AS (SELECT CAST(o_custkey AS DOUBLE) AS RSUBJ_ID, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 900 AS DOUBLE) END AS DOSEDAY_001, CASE WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderkey % 900 + 14 AS DOUBLE) END AS DOSEDAY_003
  FROM orders WHERE o_orderstatus = 'F')
"""


def _form2(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    k, n, q = F.col("o_orderkey"), F.col("l_linenumber"), F.col("l_quantity")
    who, visit = F.col("o_custkey").cast("double").alias("RSUBJ_ID"), (k % 4 + 1).cast("double").alias("VISIT_ID")
    day = (k % 400).cast("double")
    flag = F.col("l_returnflag")
    lesions = li.withColumnRenamed("l_orderkey", "o_orderkey").join(o.select("o_orderkey", "o_custkey"), "o_orderkey").select(
        who, visit, F.when(n <= 4, "Target lesion").otherwise("Non-target").alias("LESTYPE"), F.when(n < 7, n.cast("double")).alias("LESNUM"),
        F.col("l_linestatus").alias("LESLOC"), F.when((n <= 4) & (q > 3), q).alias("TGTSIZE"),
        F.when(flag == "R", "Disappeared").when(flag == "A", "Cannot be seen").otherwise("Stable").alias("QUAN"), F.when(k % 9 != 0, day).alias("EXAMDAY"))
    responses = o.select(
        who, visit, day.alias("EXAMDAY"), F.when(k % 4 == 0, "pr").when(k % 4 == 1, "SD").when(k % 4 == 2, "{---}").otherwise("PD").alias("TGTRESP"),
        F.when(k % 5 == 0, "CR").alias("NTGTRESP"), F.when(k % 3 == 0, "SD").otherwise("XX").alias("ALLRESP"), F.when(k % 6 == 0, F.col("o_totalprice")).alias("SUMTGT"))
    c, ck = table(spark, sf, "customer"), F.col("c_custkey")
    me = ck.cast("double").alias("RSUBJ_ID")
    demo = c.select(me, (ck % 80).cast("double").alias("AGE"), (ck % 4).cast("string").alias("RACE_GEN"), F.when(ck % 3 == 0, "A").otherwise(" ").alias("ELIG_007"))
    eosr = c.select(me, (ck % 3).cast("string").alias("EOSR_003"), F.col("c_mktsegment").alias("EOSR_004"), (ck % 700).cast("double").alias("EOSRDAY_001"))
    e, ek = table(spark, sf, "events"), F.col("event_id")
    toxy = e.select(F.col("user_id").cast("double").alias("RSUBJ_ID"), ek.cast("double").alias("TOXYDAY_000"), (ek % 5).cast("string").alias("TOXY_001"), F.lit("U").alias("TOXY_002"),
                    F.when(F.col("event_type") == "click", "2").alias("TOXY_003"), F.lit("0").alias("TOXY_004"), (ek % 3).cast("string").alias("TOXY_005"), F.lit("").alias("TOXY_006"))
    start = (k % 900).cast("double")
    dose = o.filter("o_orderstatus = 'F'").select(who, F.when(k % 4 != 0, start).alias("DOSEDAY_001"), F.when(k % 8 != 0, start + 14).alias("DOSEDAY_003"))
    return mapping.map_visit_form({"lesions": lesions, "responses": responses, "demo": demo, "eosr": eosr, "toxy": toxy, "dose": dose},
                                  mapping.TrialConfig("ST2", screening_visit=1.0), measured=True)


def _iso(col: str) -> str:
    return f"coalesce(CAST(CAST(DATE '2010-01-01' + CAST({col} AS INTEGER) * INTERVAL 1 DAY AS DATE) AS VARCHAR), '')"


SID2 = "concat('ST2-', CAST(CAST(RSUBJ_ID AS BIGINT) AS VARCHAR))"
LES2 = "concat(CASE WHEN LESTYPE LIKE 'Target%' THEN 'T' ELSE 'NT' END, CAST(CAST(LESNUM AS BIGINT) AS VARCHAR))"


@query("M05", FORM2 + f"""SELECT {SID2} AS USUBJID, VISIT_ID AS VISITNUM, {LES2} AS TRLNKID, CASE WHEN LESTYPE LIKE 'Target%' THEN 'LDIAM' ELSE 'TUMSTATE' END AS TRTESTCD,
  TGTSIZE AS TRSTRESN, CASE WHEN LESTYPE LIKE 'Target%' THEN coalesce(CAST(TGTSIZE AS VARCHAR), '') WHEN QUAN = 'Disappeared' THEN 'ABSENT' WHEN QUAN = 'Cannot be seen' THEN 'NOT EVALUABLE' ELSE 'PRESENT' END AS TRORRES,
  CASE WHEN LESTYPE LIKE 'Target%' AND TGTSIZE IS NULL THEN 'NOT DONE' ELSE '' END AS TRSTAT, {_iso('EXAMDAY')} AS TRDTC FROM lesions WHERE LESNUM IS NOT NULL""")
def _(spark, sf):
    return _form2(spark, sf).raw("TR").select("USUBJID", "VISITNUM", "TRLNKID", "TRTESTCD", "TRSTRESN", "TRORRES", "TRSTAT", "TRDTC")


@query("M05-TU", FORM2 + f""", x AS (SELECT {SID2} AS USUBJID, VISIT_ID AS v, {LES2} AS les, LESLOC FROM lesions WHERE LESNUM IS NOT NULL)
  SELECT USUBJID, m AS VISITNUM, CAST(row_number() OVER (PARTITION BY USUBJID ORDER BY m, les) AS DOUBLE) AS TUSEQ, les AS TULNKID FROM (SELECT USUBJID, les, min(v) AS m FROM x GROUP BY ALL)""")
def _(spark, sf):
    return _form2(spark, sf).raw("TU").select("USUBJID", "VISITNUM", "TUSEQ", "TULNKID")


@query("M05-RS", FORM2 + f""", u AS (SELECT *, 1 AS n, 'OVRESP' AS t, upper(TGTRESP) AS a, NULL AS x FROM responses WHERE upper(TGTRESP) IN ('CR','PR','SD','PD','NE','ND')
    UNION ALL SELECT *, 2, 'NTRGRESP', NTGTRESP, NULL FROM responses WHERE NTGTRESP IN ('CR','PR','SD','PD','NE','ND') UNION ALL SELECT *, 3, 'OVRLRESP', ALLRESP, NULL FROM responses WHERE ALLRESP IN ('CR','PR','SD','PD','NE','ND')
    UNION ALL SELECT *, 4, 'SUMDIAM', '', SUMTGT FROM responses WHERE SUMTGT IS NOT NULL)
  SELECT {SID2} AS USUBJID, VISIT_ID AS VISITNUM, t AS RSTESTCD, a AS RSORRES, x AS RSSTRESN, {_iso('EXAMDAY')} AS RSDTC, CASE WHEN VISIT_ID = 1 THEN 'SCREENING' ELSE 'TREATMENT' END AS EPOCH,
    CAST(row_number() OVER (PARTITION BY RSUBJ_ID ORDER BY VISIT_ID, {_iso('EXAMDAY')}, n, a, x) AS DOUBLE) AS RSSEQ FROM u""")
def _(spark, sf):
    return _form2(spark, sf).raw("RS").select("USUBJID", "VISITNUM", "RSTESTCD", "RSORRES", "RSSTRESN", "EPOCH", "RSSEQ", "RSDTC")


EXD = f""", ex2 AS (SELECT {SID2} AS USUBJID, {_iso('DOSEDAY_001')} AS s, {_iso('DOSEDAY_003')} AS e, DOSEDAY_001 AS day FROM dose WHERE DOSEDAY_001 IS NOT NULL OR DOSEDAY_003 IS NOT NULL)
"""


@query("M06", FORM2 + EXD + f""", r AS (SELECT USUBJID, min(nullif(s, '')) AS a, max(nullif(e, '')) AS b FROM ex2 GROUP BY ALL)
  SELECT {SID2} AS USUBJID, AGE, CASE RACE_GEN WHEN '1' THEN 'WHITE' WHEN '2' THEN 'BLACK OR AFRICAN AMERICAN' ELSE 'UNKNOWN' END AS RACE,
    CASE WHEN ELIG_007 = 'A' THEN 'A' ELSE 'B' END AS ARMCD, coalesce(a, '') AS RFXSTDTC, coalesce(b, '') AS RFXENDTC FROM demo LEFT JOIN r ON r.USUBJID = {SID2}""")
def _(spark, sf):
    return _form2(spark, sf).raw("DM").select("USUBJID", "AGE", "RACE", "ARMCD", "RFXSTDTC", "RFXENDTC")


@query("M07", FORM2 + f"""SELECT {SID2} AS USUBJID, CASE EOSR_003 WHEN '1' THEN 'DISCONTINUED' WHEN '2' THEN 'COMPLETED' ELSE 'OTHER' END AS DSDECOD, EOSR_004 AS DSTERM,
  {_iso('EOSRDAY_001')} AS DSSTDTC, CAST(1 AS DOUBLE) AS DSSEQ FROM eosr""")
def _(spark, sf):
    return _form2(spark, sf).raw("DS").select("USUBJID", "DSDECOD", "DSTERM", "DSSTDTC", "DSSEQ")


@query("M07-TA", FORM2 + "SELECT * FROM (VALUES ('A', 'Treatment A', 1::DOUBLE), ('B', 'Treatment B', 2::DOUBLE)) t(ARMCD, ARM, TASEQ) WHERE ARMCD IN (SELECT CASE WHEN ELIG_007 = 'A' THEN 'A' ELSE 'B' END FROM demo)")
def _(spark, sf):
    return _form2(spark, sf).raw("TA").select("ARMCD", "ARM", "TASEQ")


@query("M08", FORM2 + f""", u AS (SELECT RSUBJ_ID, TOXYDAY_000 AS day, 0 AS n, 'Nausea' AS term, TOXY_001 AS g FROM toxy UNION ALL SELECT RSUBJ_ID, TOXYDAY_000, 1, 'Vomiting', TOXY_002 FROM toxy
    UNION ALL SELECT RSUBJ_ID, TOXYDAY_000, 2, 'Diarrhea', TOXY_003 FROM toxy UNION ALL SELECT RSUBJ_ID, TOXYDAY_000, 3, 'Mucositis/stomatitis', TOXY_004 FROM toxy
    UNION ALL SELECT RSUBJ_ID, TOXYDAY_000, 4, 'Alopecia', TOXY_005 FROM toxy UNION ALL SELECT RSUBJ_ID, TOXYDAY_000, 5, 'Infection', TOXY_006 FROM toxy)
  SELECT {SID2} AS USUBJID, CAST(row_number() OVER (PARTITION BY RSUBJ_ID ORDER BY day, n, g) AS DOUBLE) AS AESEQ, term AS AETERM, g AS AETOXGR,
    CASE g WHEN '1' THEN 'MILD' WHEN '2' THEN 'MODERATE' ELSE 'SEVERE' END AS AESEV, {_iso('day')} AS AESTDTC FROM u WHERE g IN ('1', '2', '3')""")
def _(spark, sf):
    return _form2(spark, sf).raw("AE").select("USUBJID", "AESEQ", "AETERM", "AETOXGR", "AESEV", "AESTDTC")


@query("M09", FORM2 + EXD + "SELECT USUBJID, CAST(row_number() OVER (PARTITION BY USUBJID ORDER BY day NULLS LAST, e) AS DOUBLE) AS EXSEQ, s AS EXSTDTC, e AS EXENDTC FROM ex2")
def _(spark, sf):
    return _form2(spark, sf).raw("EX").select("USUBJID", "EXSEQ", "EXSTDTC", "EXENDTC")


def queries() -> dict:
    return Q


def oracle() -> dict:
    return O
