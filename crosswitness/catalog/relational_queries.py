"""Enrichment, integrity, join, aggregate, window, ordering and scalar operators on the study."""

from __future__ import annotations

import datetime as dt

from functools import reduce

from pyspark.sql import functions as F

from crosswitness.catalog.check_queries import CELLS, flags_cte
from crosswitness.catalog.flag_queries import EVENT_FLAGS, event_flags
from crosswitness.catalog.testbed import PRELUDE, study, table
from crosswitness.functions import columns as cols
from crosswitness.functions import leaves as lv
from crosswitness.functions import scalars as sc
from crosswitness.operators.ordered import numbered, position, previous, running_min
from crosswitness.operators.skew import keyed_join, measure, pair_join
from crosswitness.operators.temporal import newest_before, within_days
from crosswitness.plans import enrich, integrity
from crosswitness.plans import facts as fx
from crosswitness.plans.checks import run_checks
from crosswitness.plans.lookup import new_lesion_text
from crosswitness.sources.staging import required_root
from crosswitness.sources.study import target_flag

Q: dict = {}
O: dict = {}


def query(name: str, sql: str, prelude: str = PRELUDE):
    """Register a function of (study, session, folder) together with its SQL."""
    def add(fn):
        Q[name] = lambda spark, sf: fn(study(spark, sf), spark, sf)
        if sql:
            O[name] = prelude + sql
        return fn
    return add


def cnt(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


# -- projections and enrichment ------------------------------------------------------
DMH = "substr(md5(concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in CELLS["DM"]) + ")), 1, 12)"


@query("PRJ01", f"SELECT STUDYID, USUBJID, {DMH} AS row_key FROM dm")
def _(st, spark, sf):
    dm = st.raw("DM")
    return dm.select("STUDYID", "USUBJID", cols.row_hash(dm).alias("row_key"))


@query("PRJ02", f"SELECT USUBJID AS subject, count(*) AS n FROM (SELECT * FROM tu) GROUP BY USUBJID")
def _(st, spark, sf):
    tu = cols.with_record_id(st.raw("TU"), "TU")
    return tu.groupBy(cols.subject_of(F.col("record_id")).alias("subject")).agg(cnt())


@query("PRJ03", "SELECT TRSPID, upper(TRGRPID) = 'TARGET' AS TRTARGETLN FROM tr")
def _(st, spark, sf):
    return target_flag(st.raw("TR").drop("TRTARGETLN")).select("TRSPID", "TRTARGETLN")


@query("PRJ04", """SELECT USUBJID, min(CASE WHEN QNAM = 'SEX' THEN QVAL END) AS SUPP_SEX, min(CASE WHEN QNAM = 'RACE1' THEN QVAL END) AS SUPP_RACE1
  FROM suppdm GROUP BY USUBJID""")
def _(st, spark, sf):
    return enrich.pivot_qualifiers(st, ["SEX", "RACE1"])


ENRICH = """, f AS (SELECT USUBJID, arg_min(VISITNUM, struct_pack(a := VISITNUM, b := RSSEQ)) AS v, arg_min(RSDTC, struct_pack(a := VISITNUM, b := RSSEQ)) AS dt,
    max(RSSEQ) AS last FROM rs GROUP BY USUBJID),
  el AS (SELECT DISTINCT USUBJID FROM rs WHERE RSTESTCD = 'OVRLRESP' AND RSORRES IN ('CR', 'PR', 'SD', 'PD', 'NE'))
"""


@query("PRJ05", ENRICH + """SELECT USUBJID, VISITNUM, RSSEQ, RSTESTCD, RSORRES, RSDTC FROM rs UNION ALL
  SELECT USUBJID, v, last + 1, 'NTOVRLRESP', 'NON-CR/NON-PD', dt FROM f WHERE USUBJID IN (SELECT USUBJID FROM el) UNION ALL
  SELECT USUBJID, v, last + 2, 'NEWLEC', 'N', dt FROM f WHERE USUBJID IN (SELECT USUBJID FROM el)""")
def _(st, spark, sf):
    return enrich.enrich_responses(st)["RS"].select("USUBJID", "VISITNUM", "RSSEQ", "RSTESTCD", "RSORRES", "RSDTC")


@query("PRJ06", ENRICH + """SELECT USUBJID, VISITNUM, RSSEQ, RSTESTCD, RSORRES, RSDTC FROM rs UNION ALL
  SELECT USUBJID, v, last + 1, 'NTOVRLRESP', 'NON-CR/NON-PD', dt FROM f UNION ALL SELECT USUBJID, v, last + 2, 'NEWLEC', 'N', dt FROM f""")
def _(st, spark, sf):
    return enrich.enrich_responses(st, blanket=True)["RS"].select("USUBJID", "VISITNUM", "RSSEQ", "RSTESTCD", "RSORRES", "RSDTC")


@query("PRJ07", ENRICH + "SELECT USUBJID FROM el")
def _(st, spark, sf):
    return enrich.eligible_subjects(st)


@query("PRJ08", """SELECT DISTINCT USUBJID, 'Y' AS newlec FROM tu WHERE VISITNUM > 12""")
def _(st, spark, sf):
    # lesions that appear late carry the marker in their result text
    marked = st.with_tables(TU=st.raw("TU").withColumn("TUORRES", F.when(F.col("VISITNUM") > 12, "New lesion").otherwise("Known lesion")))
    return enrich.new_lesion_status(marked).withColumnRenamed("_newlec", "newlec")


@query("PRJ09", """SELECT USUBJID, bool_or(TUCAT = 'NON-TARGET LESION' AND VISITNUM > 9) AS new_text FROM tu GROUP BY USUBJID""")
def _(st, spark, sf):
    marked = st.with_tables(TU=st.raw("TU").withColumn(
        "TUTEST", F.when((F.col("TUCAT") == "NON-TARGET LESION") & (F.col("VISITNUM") > 9), "New lesion").otherwise("Lesion")))
    return new_lesion_text(marked).withColumnRenamed("_new_text", "new_text")


@query("PRJ10", flags_cte(["A06", "A09", "S7"]) + """SELECT subject, rule_id, severity, regexp_extract(record_id, '^([A-Z]+)/', 1) AS domain,
  CASE rule_id WHEN 'A06' THEN 'TRORRES=UNEQUIVOCAL PROGRESSION' ELSE NULL END AS message FROM flags WHERE rule_id <> 'S7'""")
def _(st, spark, sf):
    f = run_checks(st, ["A06", "A09"])
    rule = F.coalesce(F.get("core_rule_xref", F.lit(0)), F.col("archetype"), F.lit("unknown"))
    text = F.concat_ws("; ", F.transform("evidence", lambda e: F.concat_ws("=", e["type"], e["value"])))
    return f.select("subject", rule.alias("rule_id"), "severity", F.regexp_extract("record_id", "^([A-Z]+)/", 1).alias("domain"),
                    F.when(F.col("archetype") == "A06", text).alias("message"))


@query("PRJ11", EVENT_FLAGS + """SELECT event_id, coalesce(CASE rule_id WHEN 'click' THEN 'A01' WHEN 'view' THEN 'A02' END, rule_id) AS archetype FROM ef""", "")
def _(st, spark, sf):
    names = F.broadcast(spark.range(1).select(F.inline(F.array(
        F.struct(F.lit("click").alias("rule_id"), F.lit("A01").alias("mapped")), F.struct(F.lit("view").alias("rule_id"), F.lit("A02").alias("mapped"))))))
    return event_flags(spark, sf).join(names, "rule_id", "left").select("event_id", F.coalesce("mapped", "rule_id").alias("archetype"))


@query("PRJ12", EVENT_FLAGS + """SELECT event_id, CASE rule_id WHEN 'click' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'violation' END AS severity FROM ef""", "")
def _(st, spark, sf):
    return event_flags(spark, sf).select("event_id", sc.code_map(F.col("rule_id"), {"click": "warning", "view": "info"}, "violation").alias("severity"))


@query("PRJ13", """SELECT USUBJID, RSSEQ, CASE WHEN RSORRES = 'Y' THEN 'YES' WHEN RSORRES = 'N' THEN 'NO' ELSE upper(trim(RSORRES)) END AS norm,
  CASE WHEN RSORRES = 'Y' THEN 'YES' WHEN RSORRES = 'N' THEN 'NO' WHEN RSORRES = 'NON-CR/NON-PD' THEN 'SD' ELSE upper(trim(RSORRES)) END AS norm_target FROM rs""")
def _(st, spark, sf):
    return st["RS"].select("USUBJID", "RSSEQ", sc.norm_response(F.col("RSORRES")).alias("norm"), sc.norm_target(F.col("RSORRES")).alias("norm_target"))


RESTRICTED = ("AE", "DM", "DS", "EX", "RELREC", "RS", "SUPPDM", "TR", "TU")


@query("PRJ14", ", d AS (SELECT DISTINCT USUBJID FROM ds WHERE DSDECOD = 'DEATH') " + " UNION ALL ".join(
    [f"SELECT '{d}' AS domain, count(*) AS n FROM {d.lower()} WHERE USUBJID IN (FROM d)" for d in RESTRICTED] + ["SELECT 'TA', count(*) FROM ta"]))
def _(st, spark, sf):
    kept = enrich.restrict(st, st["DS"].filter("DSDECOD = 'DEATH'"))
    parts = [kept[d].agg(cnt()).select(F.lit(d).alias("domain"), "n") for d in (*RESTRICTED, "TA")]
    return reduce(lambda x, y: x.unionAll(y), parts)


@query("PRJ15", """SELECT CASE WHEN k = 0 THEN USUBJID ELSE concat(USUBJID, '_R', CAST(k AS VARCHAR)) END AS USUBJID, EXSEQ, EXSTDTC FROM ex, range(3) t(k)""")
def _(st, spark, sf):
    return enrich.replicate(st, 3)["EX"].select("USUBJID", "EXSEQ", "EXSTDTC")


@query("PRJ15-ALL", " UNION ALL ".join([f"""SELECT '{d}' AS domain, CASE WHEN k = 0 THEN USUBJID ELSE concat(USUBJID, '_R', CAST(k AS VARCHAR)) END AS USUBJID, count(*) AS n
  FROM {d.lower()}, range(3) t(k) GROUP BY ALL""" for d in RESTRICTED] + ["SELECT 'TA', NULL, count(*) FROM ta"]))
def _(st, spark, sf):
    copies = enrich.replicate(st, 3)
    parts = [copies[d].groupBy(F.lit(d).alias("domain"), "USUBJID").agg(cnt()) for d in RESTRICTED]
    parts.append(copies["TA"].agg(cnt()).select(F.lit("TA").alias("domain"), F.lit(None).cast("string").alias("USUBJID"), "n"))
    return reduce(lambda x, y: x.unionAll(y), parts)


# -- integrity ----------------------------------------------------------------------------
@query("P01", """, k AS (SELECT 'EX' AS d, USUBJID FROM ex UNION SELECT 'AE', USUBJID FROM ae UNION SELECT 'DS', USUBJID FROM ds)
  SELECT RDOMAIN, USUBJID, RELID FROM relrec r WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.d = r.RDOMAIN AND k.USUBJID = r.USUBJID)""")
def _(st, spark, sf):
    return integrity.orphan_relations(st).select("RDOMAIN", "USUBJID", "RELID")


@query("P02", """SELECT TRSPID FROM tr WHERE NOT EXISTS (SELECT 1 FROM tu WHERE tu.USUBJID = tr.USUBJID AND tu.TULNKID = tr.TRLNKID
  AND NOT (tu.VISITNUM > 12))""")
def _(st, spark, sf):
    return integrity.orphan_lesions(st.with_tables(TU=st.raw("TU").filter("NOT VISITNUM > 12"))).select("TRSPID")


@query("P03", """, m AS (SELECT USUBJID FROM dm WHERE ARMCD <> 'TRTARMX')
  SELECT 'EX' AS domain, USUBJID FROM (SELECT DISTINCT USUBJID FROM ex) WHERE USUBJID NOT IN (FROM m)
  UNION ALL SELECT 'TU', USUBJID FROM (SELECT DISTINCT USUBJID FROM tu) WHERE USUBJID NOT IN (FROM m)
  UNION ALL SELECT 'TR', USUBJID FROM (SELECT DISTINCT USUBJID FROM tr) WHERE USUBJID NOT IN (FROM m)
  UNION ALL SELECT 'RS', USUBJID FROM (SELECT DISTINCT USUBJID FROM rs) WHERE USUBJID NOT IN (FROM m)
  UNION ALL SELECT 'AE', USUBJID FROM (SELECT DISTINCT USUBJID FROM ae) WHERE USUBJID NOT IN (FROM m)
  UNION ALL SELECT 'DS', USUBJID FROM (SELECT DISTINCT USUBJID FROM ds) WHERE USUBJID NOT IN (FROM m)
  UNION ALL SELECT 'SUPPDM', USUBJID FROM (SELECT DISTINCT USUBJID FROM suppdm) WHERE USUBJID NOT IN (FROM m)""")
def _(st, spark, sf):
    return integrity.unknown_subjects(st.with_tables(DM=st.raw("DM").filter("ARMCD <> 'TRTARMX'"))).select("domain", "USUBJID")


@query("P04", """SELECT 'RS' AS domain, 'RSORRES' AS "column", RSORRES AS value, count(*) AS count FROM rs
  WHERE RSORRES <> '' AND RSORRES NOT IN ('CR', 'PR', 'SD', 'PD', 'NE', 'ND', 'iCPD', 'NON-CR/NON-PD') GROUP BY RSORRES""")
def _(st, spark, sf):
    return integrity.off_list_codes(st)


@query("P05", """, m AS (SELECT USUBJID, VISITNUM, sum(TRSTRESN) AS s FROM tr WHERE TRTESTCD = 'LDIAM' GROUP BY ALL)
  SELECT count(*) AS visits, count_if(abs(m.s - r.RSSTRESN) <= 1) AS matching, count_if(abs(m.s - r.RSSTRESN) <= 1) / count(*) AS rate
  FROM rs r JOIN m ON m.USUBJID = r.USUBJID AND m.VISITNUM = r.VISITNUM WHERE r.RSTESTCD = 'SUMDIAM' AND r.RSSTRESN IS NOT NULL""")
def _(st, spark, sf):
    return integrity.sum_match_rate(st)


@query("P06", """, b AS (SELECT USUBJID, min(VISITNUM) AS b FROM tr WHERE EPOCH = 'SCREENING' GROUP BY USUBJID),
  n AS (SELECT count_if(tu.VISITNUM > b.b) AS a FROM tu JOIN b USING (USUBJID)),
  s AS (SELECT count_if(f) AS c FROM (SELECT l_orderkey % 50 AS x, l_linenumber AS y, bool_or(l_returnflag = 'R') AS f FROM lineitem GROUP BY ALL))
  SELECT a AS mapped_new, c AS source_new, a = c AS equal FROM n, s""")
def _(st, spark, sf):
    marks = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("subject"), F.col("l_linenumber").alias("lesion"),
                                                F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No").alias("new"))
    return integrity.new_lesion_counts(st, marks)


@query("P07", """SELECT USUBJID, concat(VISITNUM, '/', TRLNKID) AS record_key, count(*) AS count FROM tr GROUP BY ALL HAVING count(*) > 1""")
def _(st, spark, sf):
    rows = st.with_tables(TR=st.raw("TR").withColumn("TRSPID", F.concat_ws("/", F.col("VISITNUM").cast("string"), "TRLNKID")))
    return integrity.duplicate_records(rows, "TR")


@query("P08", """, x AS (SELECT (SELECT count(*) FROM ae WHERE AEREL IN ('Y', 'PROBABLE', 'POSSIBLE')) AS attributed)
  SELECT 'A03' AS check_id, 'adverse events carry no attribution' AS reason FROM x WHERE attributed = 0
  UNION ALL SELECT unnest(['A10', 'A11', 'A15']), 'no exposure records' UNION ALL SELECT 'A14', 'exposure or actual arm is not recorded'
  UNION ALL SELECT unnest(['A07', 'A20']), 'responses carry no full dates'""")
def _(st, spark, sf):
    # a sparser variant of the study: no exposure table, year-only response dates
    tables = {d: df for d, df in st.tables.items() if d != "EX"}
    tables["RS"] = tables["RS"].withColumn("RSDTC", F.substring("RSDTC", 1, 4))
    return integrity.not_applicable(type(st)(spark, tables))


# -- joins ----------------------------------------------------------------------------------
@query("J01", "SELECT e.USUBJID, e.EXSEQ, d.SEX FROM ex e JOIN dm d ON d.USUBJID = e.USUBJID")
def _(st, spark, sf):
    # a subject can have several demographics records, so neither side is unique
    return pair_join(st["EX"].select("USUBJID", "EXSEQ"), st["DM"].select("USUBJID", "SEX"), ["USUBJID"], loads=(st.load("EX"), st.load("DM")))


@query("J02", """SELECT t.TRSPID, r.RSORRES FROM tr t JOIN rs r ON r.USUBJID = t.USUBJID AND r.VISITNUM = t.VISITNUM WHERE r.RSTESTCD = 'OVRLRESP'""")
def _(st, spark, sf):
    at = ("USUBJID", "VISITNUM")
    sides = st["TR"].select(*at, "TRSPID"), st["RS"].filter(fx.is_overall()).select(*at, "RSORRES")
    loads = measure({str(n): (df, at) for n, df in enumerate(sides)})
    return pair_join(*sides, list(at), loads=(loads["0"], loads["1"])).select("TRSPID", "RSORRES")


LES = ", lv AS (SELECT USUBJID, TRLNKID, VISITNUM, max(TRSTRESN) AS m FROM tr WHERE TRTESTCD = 'LDIAM' GROUP BY ALL)\n"


def _lesion_visits(st):
    return st["TR"].filter("TRTESTCD = 'LDIAM'").groupBy("USUBJID", "TRLNKID", "VISITNUM").agg(F.max("TRSTRESN").alias("m"))


@query("J03", LES + """SELECT a.USUBJID, a.TRLNKID, a.VISITNUM, a.m - b.m AS change FROM lv a JOIN lv b ON a.USUBJID = b.USUBJID AND a.TRLNKID = b.TRLNKID
  WHERE b.VISITNUM = (SELECT max(c.VISITNUM) FROM lv c WHERE c.USUBJID = a.USUBJID AND c.TRLNKID = a.TRLNKID AND c.VISITNUM < a.VISITNUM)""")
def _(st, spark, sf):
    # the lesion self-join is a look-back, so it is a window
    seen = previous(_lesion_visits(st), ["USUBJID", "TRLNKID"], "VISITNUM", "m", "before", st.load("TR"))
    return seen.filter("before IS NOT NULL").select("USUBJID", "TRLNKID", "VISITNUM", (F.col("m") - F.col("before")).alias("change"))


@query("J04", """SELECT USUBJID, AESEQ FROM ae t WHERE EXISTS (SELECT 1 FROM ex e WHERE e.USUBJID = t.USUBJID
  AND date_diff('day', CAST(t.AESTDTC AS DATE), CAST(e.EXSTDTC AS DATE)) > 7)""")
def _(st, spark, sf):
    # "some dose more than a week later" only needs the latest dose, so the range join becomes a lookup
    last = st["EX"].groupBy("USUBJID").agg(F.max(sc.full_date(F.col("EXSTDTC"))).alias("last"))
    hits = keyed_join(st["AE"], last, ["USUBJID"], "inner", st.load("AE"))
    return hits.filter(F.datediff("last", sc.full_date(F.col("AESTDTC"))) > 7).select("USUBJID", "AESEQ")


@query("J05", LES + """SELECT a.USUBJID, a.TRLNKID, a.VISITNUM, b.VISITNUM AS before FROM lv a ASOF JOIN lv b
  ON a.USUBJID = b.USUBJID AND a.TRLNKID = b.TRLNKID AND a.VISITNUM > b.VISITNUM""")
def _(st, spark, sf):
    return previous(_lesion_visits(st), ["USUBJID", "TRLNKID"], "VISITNUM", "VISITNUM", "before", st.load("TR")).filter(
        "before IS NOT NULL").select("USUBJID", "TRLNKID", "VISITNUM", "before")


@query("J04-RANGE", """SELECT a.USUBJID, a.AESEQ, e.EXSEQ FROM ae a JOIN ex e ON e.USUBJID = a.USUBJID
  AND abs(date_diff('day', CAST(a.AESTDTC AS DATE), CAST(e.EXSTDTC AS DATE))) <= 30""")
def _(st, spark, sf):
    return within_days(st["AE"].select("USUBJID", "AESEQ", "AESTDTC"), st["EX"].select("USUBJID", "EXSEQ", "EXSTDTC"), ["USUBJID"],
                       sc.full_date(F.col("AESTDTC")), sc.full_date(F.col("EXSTDTC")), 30).select("USUBJID", "AESEQ", "EXSEQ")


@query("J05-ASOF", """SELECT a.USUBJID, a.AESEQ, coalesce((SELECT arg_max(e.EXSEQ, struct_pack(d := e.EXSTDTC, s := e.EXSEQ)) FROM ex e
    WHERE e.USUBJID = a.USUBJID AND e.EXSTDTC <= a.AESTDTC), -1) AS EXSEQ FROM ae a""")
def _(st, spark, sf):
    dose = newest_before(st["AE"].select("USUBJID", "AESEQ", "AESTDTC"), st["EX"].select("USUBJID", "EXSEQ", "EXSTDTC"), ["USUBJID"],
                         sc.full_date(F.col("AESTDTC")), sc.full_date(F.col("EXSTDTC")), ["EXSEQ"], "EXSEQ", "dose")
    return dose.select("USUBJID", "AESEQ", F.coalesce("dose.EXSEQ", F.lit(-1)).alias("EXSEQ"))


@query("J06", "SELECT USUBJID, EXSEQ FROM ex t WHERE EXISTS (SELECT 1 FROM ae x WHERE x.USUBJID = t.USUBJID AND x.AEREL = 'PROBABLE')")
def _(st, spark, sf):
    who = st["AE"].filter("AEREL = 'PROBABLE'").select("USUBJID").distinct()
    return keyed_join(st["EX"], who, ["USUBJID"], "left_semi", st.load("EX")).select("USUBJID", "EXSEQ")


@query("J07", "SELECT USUBJID, EXSEQ FROM ex t WHERE NOT EXISTS (SELECT 1 FROM ae x WHERE x.USUBJID = t.USUBJID AND x.AEREL = 'PROBABLE')")
def _(st, spark, sf):
    who = st["AE"].filter("AEREL = 'PROBABLE'").select("USUBJID").distinct()
    return keyed_join(st["EX"], who, ["USUBJID"], "left_anti", st.load("EX")).select("USUBJID", "EXSEQ")


@query("J08", f"SELECT USUBJID, STUDYID FROM dm t WHERE EXISTS (SELECT 1 FROM dm x WHERE x.ARMCD = t.ARMCD AND x.ARM <> t.ARM)")
def _(st, spark, sf):
    return keyed_join(st["DM"], fx.dm_arm(st), ["ARMCD"], "left", st.load("DM by ARMCD")).filter("_arm_min <> _arm_max").select("USUBJID", "STUDYID")


@query("J09", "SELECT USUBJID, STUDYID, ta.ARM AS arm_name FROM dm LEFT JOIN ta ON ta.ARMCD = dm.ARMCD")
def _(st, spark, sf):
    names = st["TA"].groupBy("ARMCD").agg(F.min("ARM").alias("arm_name"))
    return keyed_join(st["DM"], names, ["ARMCD"], "left", st.load("DM by ARMCD")).select("USUBJID", "STUDYID", "arm_name")


@query("J11", """, a AS (SELECT USUBJID, sum(TRSTRESN) AS s FROM tr GROUP BY USUBJID), b AS (SELECT USUBJID, sum(RSSTRESN) AS r FROM rs GROUP BY USUBJID)
  SELECT USUBJID, s, r FROM a JOIN b USING (USUBJID) WHERE s IS NOT NULL AND r IS NOT NULL""")
def _(st, spark, sf):
    a = st["TR"].groupBy("USUBJID").agg(F.sum("TRSTRESN").alias("s"))
    b = st["RS"].groupBy("USUBJID").agg(F.sum("RSSTRESN").alias("r"))
    return a.join(b, "USUBJID").dropna()


@query("J12", "SELECT USUBJID, k.test FROM (SELECT DISTINCT USUBJID FROM rs), (VALUES ('NTOVRLRESP'), ('NEWLEC')) k(test)")
def _(st, spark, sf):
    # constant rows per subject are an explode, not a cross join
    return st["RS"].select("USUBJID").distinct().withColumn("test", F.explode(F.array(F.lit("NTOVRLRESP"), F.lit("NEWLEC"))))


# -- aggregates -----------------------------------------------------------------------------
@query("AG01", "SELECT USUBJID, VISITNUM, sum(TRSTRESN) AS sld FROM tr WHERE TRTESTCD = 'LDIAM' AND TRTARGETLN GROUP BY ALL")
def _(st, spark, sf):
    return fx.tr_visit(st).filter("_measured > 0").select("USUBJID", "VISITNUM", F.col("_sld").alias("sld"))


@query("AG02", "SELECT USUBJID, min(VISITNUM) AS baseline FROM tr WHERE TRTARGETLN AND EPOCH = 'SCREENING' GROUP BY ALL")
def _(st, spark, sf):
    return fx.tr_subject(st).filter("_baseline IS NOT NULL").select("USUBJID", F.col("_baseline").alias("baseline"))


NADIR = """, sl AS (SELECT USUBJID, VISITNUM, sum(TRSTRESN) AS sld FROM tr WHERE TRTESTCD = 'LDIAM' AND TRTARGETLN GROUP BY ALL),
  bl AS (SELECT USUBJID, min(VISITNUM) AS b FROM tr WHERE TRTARGETLN AND EPOCH = 'SCREENING' GROUP BY ALL)
  SELECT s.USUBJID, s.VISITNUM, (SELECT min(x.sld) FROM sl x WHERE x.USUBJID = s.USUBJID AND x.VISITNUM >= b AND x.VISITNUM <= s.VISITNUM) AS nadir
  FROM sl s JOIN bl USING (USUBJID) WHERE s.VISITNUM >= b"""


@query("AG03", NADIR)
def _(st, spark, sf):
    return fx.tr_visit(st).filter("VISITNUM >= _bl AND _sld IS NOT NULL").select("USUBJID", "VISITNUM", F.col("_nadir").alias("nadir"))


@query("AG04", """SELECT USUBJID, VISITNUM, count(TRSTRESN) AS measured FROM tr WHERE TRTESTCD = 'LDIAM' AND TRTARGETLN GROUP BY ALL
  HAVING count(TRSTRESN) > 0 AND sum(CASE WHEN TRSTRESN > 0 THEN 1 ELSE 0 END) = 0""")
def _(st, spark, sf):
    return fx.tr_visit(st).filter("_measured > 0 AND _positive = 0").select("USUBJID", "VISITNUM", F.col("_measured").alias("measured"))


@query("AG05", "SELECT count(DISTINCT USUBJID) AS subjects FROM rs")
def _(st, spark, sf):
    return st["RS"].agg(F.countDistinct("USUBJID").alias("subjects"))


@query("AG08", "SELECT USUBJID, min(nullif(EXSTDTC, '')) AS first_dose, max(nullif(EXENDTC, '')) AS last_dose FROM ex GROUP BY ALL")
def _(st, spark, sf):
    return st["EX"].groupBy("USUBJID").agg(F.min(F.nullif("EXSTDTC", F.lit(""))).alias("first_dose"), F.max(F.nullif("EXENDTC", F.lit(""))).alias("last_dose"))


@query("AG09", "SELECT ARM, row_number() OVER (ORDER BY ARM) AS n FROM (SELECT DISTINCT ARM FROM dm)")
def _(st, spark, sf):
    arms = st["DM"].select("ARM").distinct()
    return numbered(arms, [], [F.col("ARM").asc()], "n", f"{required_root(spark)}/arms")


@query("AG10", "SELECT USUBJID, bool_or(RSORRES = 'PD') AS any_pd FROM rs GROUP BY ALL")
def _(st, spark, sf):
    return st["RS"].groupBy("USUBJID").agg(F.bool_or(F.col("RSORRES") == "PD").alias("any_pd"))


# -- windows ---------------------------------------------------------------------------------
@query("W01", LES + "SELECT *, lag(m) OVER (PARTITION BY USUBJID, TRLNKID ORDER BY VISITNUM) AS before FROM lv")
def _(st, spark, sf):
    return previous(_lesion_visits(st), ["USUBJID", "TRLNKID"], "VISITNUM", "m", "before", st.load("TR"))


@query("W02", "SELECT USUBJID, TRLNKID, min(VISITNUM) AS first_visit, count(*) AS n FROM tr GROUP BY ALL")
def _(st, spark, sf):
    return st["TR"].groupBy("USUBJID", "TRLNKID").agg(F.min("VISITNUM").alias("first_visit"), cnt())


@query("W03", "SELECT USUBJID, EXSEQ, row_number() OVER (PARTITION BY USUBJID ORDER BY EXSTDTC, EXSEQ) AS seq FROM ex")
def _(st, spark, sf):
    return position(st["EX"].select("USUBJID", "EXSEQ", "EXSTDTC"), ["USUBJID"], [F.col("EXSTDTC"), F.col("EXSEQ")], "seq",
                    F.col("EXSTDTC"), st.load("EX")).select("USUBJID", "EXSEQ", "seq")


@query("W04", "SELECT USUBJID, RSSEQ, max(VISITNUM) OVER (PARTITION BY USUBJID) > VISITNUM AS later FROM rs")
def _(st, spark, sf):
    return keyed_join(st["RS"], fx.rs_subject(st), ["USUBJID"], "left", st.load("RS")).select(
        "USUBJID", "RSSEQ", (F.col("_last_visit") > F.col("VISITNUM")).alias("later"))


@query("W05", """, s AS (SELECT USUBJID, VISITNUM, sum(TRSTRESN) AS sld FROM tr WHERE TRTESTCD = 'LDIAM' GROUP BY ALL)
  SELECT USUBJID, VISITNUM, min(sld) OVER (PARTITION BY USUBJID ORDER BY VISITNUM ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM s""")
def _(st, spark, sf):
    sld = st["TR"].filter("TRTESTCD = 'LDIAM'").groupBy("USUBJID", "VISITNUM").agg(F.sum("TRSTRESN").alias("sld"))
    return running_min(sld, ["USUBJID"], "VISITNUM", "sld", "low", st.load("TR")).select("USUBJID", "VISITNUM", "low")


@query("W06", "SELECT USUBJID, STUDYID, count(*) OVER (PARTITION BY USUBJID) AS n FROM dm")
def _(st, spark, sf):
    return keyed_join(st["DM"], fx.dm_subject(st), ["USUBJID"], "left", st.load("DM")).select("USUBJID", "STUDYID", F.col("_dm_rows").alias("n"))


# -- order ------------------------------------------------------------------------------------
@query("T01", flags_cte(["A08"]) + """SELECT DISTINCT USUBJID FROM dm WHERE USUBJID NOT IN (SELECT subject FROM flags) ORDER BY USUBJID LIMIT 10""")
def _(st, spark, sf):
    flagged = run_checks(st, ["A08"]).select(F.col("subject").alias("USUBJID")).distinct()
    return st["DM"].select("USUBJID").distinct().join(flagged, "USUBJID", "left_anti").orderBy("USUBJID").limit(10)


@query("T03", EVENT_FLAGS + "SELECT event_id, rule_id, severity FROM ef WHERE subject = 'U8'", "")
def _(st, spark, sf):
    return event_flags(spark, sf).filter("subject = 'U8'").select("event_id", "rule_id", "severity").orderBy("event_id")


@query("T04", "SELECT DISTINCT USUBJID FROM dm ORDER BY USUBJID LIMIT 50")
def _(st, spark, sf):
    return enrich.pick_subjects(st, 50)


@query("T05", f"SELECT USUBJID, VISITNUM, RSSEQ FROM rs")
def _(st, spark, sf):
    return st["RS"].select("USUBJID", "VISITNUM", "RSSEQ").orderBy("USUBJID", "VISITNUM", "RSSEQ")


@query("U05", """SELECT USUBJID, QNAM, QVAL, NULL AS QLABEL FROM suppdm UNION ALL SELECT USUBJID, 'SEX', CASE WHEN SEX = 'F' THEN 'M' ELSE 'F' END, 'Sex' FROM dm""")
def _(st, spark, sf):
    more = st["DM"].select("USUBJID", F.lit("SEX").alias("QNAM"), F.when(F.col("SEX") == "F", "M").otherwise("F").alias("QVAL"), F.lit("Sex").alias("QLABEL"))
    return st.raw("SUPPDM").unionByName(more, allowMissingColumns=True).select("USUBJID", "QNAM", "QVAL", "QLABEL")


# -- scalar functions ---------------------------------------------------------------------------
@query("F01", "SELECT TRSPID, CAST(VISITNUM AS VARCHAR) AS v, length(TRSPID) AS n, substr(TRSPID, 1, 4) AS head FROM tr")
def _(st, spark, sf):
    return st["TR"].select("TRSPID", F.col("VISITNUM").cast("string").alias("v"), F.length("TRSPID").cast("bigint").alias("n"), F.substring("TRSPID", 1, 4).alias("head"))


@query("F02", "SELECT TRSPID, coalesce(contains(upper(TRORRES), 'PROGRESS'), FALSE) AS hit FROM tr")
def _(st, spark, sf):
    return st["TR"].select("TRSPID", F.coalesce(F.upper("TRORRES").contains("PROGRESS"), F.lit(False)).alias("hit"))


@query("F03", "SELECT STUDYID, USUBJID, coalesce(regexp_matches(ACTARM, '^(not treated|building)$', 'i'), FALSE) AS hit FROM dm")
def _(st, spark, sf):
    return st["DM"].select("STUDYID", "USUBJID", lv.matches_regex(F.col("ACTARM"), "(?i)^(not treated|building)$").alias("hit"))


@query("F04", "SELECT USUBJID, EXSEQ, date_diff('day', DATE '1995-03-01', CAST(EXSTDTC AS DATE)) AS gap FROM ex")
def _(st, spark, sf):
    return st["EX"].select("USUBJID", "EXSEQ", sc.day_gap(F.col("EXSTDTC"), F.lit("1995-03-01")).cast("bigint").alias("gap"))


@query("F05", "SELECT USUBJID, EXSEQ, date_diff('day', CAST(EXSTDTC AS DATE), CAST(EXENDTC AS DATE)) >= 14 AS long FROM ex")
def _(st, spark, sf):
    return st["EX"].select("USUBJID", "EXSEQ", (sc.day_gap(F.col("EXENDTC"), F.col("EXSTDTC")) >= 14).alias("long"))


@query("F06", "SELECT USUBJID, EXSEQ, CAST(CAST(CAST(EXSTDTC AS DATE) - INTERVAL 7 DAY AS DATE) AS VARCHAR) AS moved FROM ex")
def _(st, spark, sf):
    return st["EX"].select("USUBJID", "EXSEQ", sc.shift_days(F.col("EXSTDTC"), -7).alias("moved"))


@query("F07", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CAST(CAST(DATE '2010-01-01' + CAST(q AS INTEGER) * INTERVAL 1 DAY AS DATE) AS VARCHAR), '') AS day
  FROM (SELECT *, CASE WHEN l_quantity > 5 THEN l_quantity END AS q FROM lineitem)""", "")
def _(st, spark, sf):
    q = F.when(F.col("l_quantity") > 5, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sc.from_offset(q, dt.date(2010, 1, 1)).alias("day"))


@query("F08", "SELECT TRSPID, CASE WHEN TRSTRESN IS NULL THEN 'none' WHEN TRSTRESN = 0 THEN 'zero' WHEN TRSTRESN < 30 THEN 'small' ELSE 'large' END AS size FROM tr")
def _(st, spark, sf):
    d = F.col("TRSTRESN")
    return st["TR"].select("TRSPID", F.when(d.isNull(), "none").when(d == 0, "zero").when(d < 30, "small").otherwise("large").alias("size"))


@query("F09", "SELECT USUBJID, RSSEQ, CAST(floor(VISITNUM) AS BIGINT) AS whole, VISITNUM - floor(VISITNUM) AS part FROM rs")
def _(st, spark, sf):
    return st["RS"].select("USUBJID", "RSSEQ", F.floor("VISITNUM").alias("whole"), (F.col("VISITNUM") - F.floor("VISITNUM")).alias("part"))


@query("F10", """SELECT o_orderkey, concat('ST-', CASE WHEN o_orderkey % 7 = 0 THEN concat('X', CAST(o_orderkey AS VARCHAR)) ELSE CAST(o_orderkey AS VARCHAR) END) AS who FROM orders""", "")
def _(st, spark, sf):
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("X"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("double").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", sc.subject_id("ST", raw).alias("who"))


@query("F11", """SELECT TRSPID, starts_with(TRLNKID, 'T') AS target, replace(upper(substr(TRORRES, 1, 8)), ' ', '') AS code FROM tr WHERE TRORRES IS NOT NULL""")
def _(st, spark, sf):
    return st["TR"].filter("TRORRES IS NOT NULL").select("TRSPID", sc.is_target_lesion(F.col("TRLNKID")).alias("target"), sc.arm_code(F.col("TRORRES")).alias("code"))


@query("F12", "SELECT STUDYID, USUBJID, CASE SEX WHEN 'M' THEN 'MALE' WHEN 'F' THEN 'FEMALE' ELSE 'UNKNOWN' END AS sex_name FROM dm")
def _(st, spark, sf):
    return st["DM"].select("STUDYID", "USUBJID", sc.code_map(F.col("SEX"), {"M": "MALE", "F": "FEMALE"}, "UNKNOWN").alias("sex_name"))


@query("F13", "SELECT TRSPID, md5(TRSPID) AS m, sha256(TRSPID) AS s FROM tr")
def _(st, spark, sf):
    return st["TR"].select("TRSPID", F.md5("TRSPID").alias("m"), F.sha2("TRSPID", 256).alias("s"))


@query("F14", """SELECT event_id, concat('{"event":"', event_type, '","user":', CAST(user_id AS VARCHAR), '}') AS j FROM events""", "")
def _(st, spark, sf):
    return table(spark, sf, "events").select("event_id", sc.canonical_json({"user": F.col("user_id"), "event": F.col("event_type")}).alias("j"))


@query("F15", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", "")
def _(st, spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


def queries() -> dict:
    return Q


def oracle() -> dict:
    return O
