"""Injections into every subject of the derived study, and the detection plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswitness.catalog.sqltext import stored
from crosswitness.catalog.testbed import PRELUDE, study
from crosswitness.plans import flagsets as fs
from crosswitness.plans import inject as ij
from crosswitness.plans.checks import run_checks

Q: dict = {}
O: dict = {}

WHO = ", who AS (SELECT DISTINCT USUBJID FROM dm)\n"
WHO_AE = ", who AS (SELECT DISTINCT USUBJID FROM ae)\n"  # deletions go to subjects with events, so rows remain
# (result table, result columns, SQL) of each injection into all subjects
V0 = ", v0 AS (SELECT USUBJID, min(VISITNUM) AS v FROM rs WHERE USUBJID IN (FROM who) GROUP BY ALL)\n"
SD = """, sd AS (SELECT USUBJID, coalesce(min(VISITNUM) FILTER (WHERE RSORRES = 'SD'), min(VISITNUM)) AS v, bool_or(RSORRES = 'SD') AS had FROM rs
  WHERE USUBJID IN (FROM who) GROUP BY ALL)\n"""
RS = ("USUBJID", "VISITNUM", "RSSEQ", "RSTESTCD", "RSORRES")
RSC = "r.USUBJID, r.VISITNUM, r.RSSEQ, r.RSTESTCD"
EXS = ", xs AS (SELECT USUBJID, min(EXSTDTC) AS a, max(EXENDTC) AS b FROM ex WHERE USUBJID IN (FROM who) GROUP BY ALL)\n"


def _rs_at(marks: str, value: str, cond: str = "TRUE") -> str:
    return f"SELECT {RSC}, CASE WHEN m.v IS NOT NULL AND {cond} THEN '{value}' ELSE r.RSORRES END AS RSORRES FROM rs r LEFT JOIN {marks} m ON m.USUBJID = r.USUBJID AND m.v = r.VISITNUM"


def _tr_at(marks: str) -> str:
    return f"""SELECT t.TRSPID, CASE WHEN m.v IS NOT NULL AND t.TRTESTCD = 'TUMSTATE' THEN 'UNEQUIVOCAL PROGRESSION' ELSE t.TRORRES END AS TRORRES
      FROM tr t LEFT JOIN {marks} m ON m.USUBJID = t.USUBJID AND m.v = t.VISITNUM"""


def _shift(expr: str, days: int) -> str:
    return f"CAST(CAST(CAST({expr} AS DATE) + INTERVAL ({days}) DAY AS DATE) AS VARCHAR)"


def _dm(col: str, expr: str, join: str = "") -> tuple:
    return ("DM", ("STUDYID", "USUBJID", col), WHO + (EXS if "x." in expr or "x." in join else "") + f"SELECT d.STUDYID, d.USUBJID, {expr} AS {col} FROM dm d {join}")


XJ = "LEFT JOIN xs x ON x.USUBJID = d.USUBJID"
SLD1 = """, sl AS (SELECT USUBJID, VISITNUM, coalesce(sum(TRSTRESN), 0) AS s FROM tr WHERE TRTESTCD = 'LDIAM' AND USUBJID IN (FROM who) GROUP BY ALL),
  en AS (SELECT USUBJID, min(VISITNUM) AS a, max(VISITNUM) AS z, arg_min(s, VISITNUM) AS s0 FROM sl GROUP BY ALL),
  m1 AS (SELECT sl.USUBJID, coalesce(min(VISITNUM) FILTER (WHERE VISITNUM > a AND s <= 0.7 * s0), max(z)) AS v FROM sl JOIN en USING (USUBJID) GROUP BY ALL)\n"""
TUN = """, ln AS (SELECT USUBJID, count(DISTINCT TULNKID) AS n, arg_max(TUCAT, struct_pack(a := VISITNUM, c := TULNKID)) AS cat FROM tu WHERE USUBJID IN (FROM who) GROUP BY ALL)\n"""
NEW_TU = "SELECT USUBJID, VISITNUM, TULNKID, TUCAT FROM tu UNION ALL SELECT USUBJID, sd.v, concat('T', lpad(CAST(n + 1 AS VARCHAR), 2, '0')), cat FROM ln JOIN sd USING (USUBJID)"
TU = ("USUBJID", "VISITNUM", "TULNKID", "TUCAT")

CASES: dict[str, tuple] = {
    "A01": ("RS", RS, WHO + SLD1 + _rs_at("m1", "PD")),
    "A02": ("TU", TU, WHO + SD + TUN + NEW_TU),
    "A03": ("EX", ("USUBJID", "EXSEQ", "EXSTDTC"), WHO + f""", on1 AS (SELECT USUBJID, coalesce(arg_min(AESTDTC, AESEQ) FILTER (WHERE AEREL = 'Y'), arg_min(AESTDTC, AESEQ)) AS o FROM ae GROUP BY ALL),
      fx AS (SELECT USUBJID, min(EXSEQ) AS s FROM ex GROUP BY ALL)
      SELECT e.USUBJID, e.EXSEQ, CASE WHEN fx.s = e.EXSEQ AND o IS NOT NULL THEN {_shift('o', 14)} ELSE e.EXSTDTC END AS EXSTDTC
      FROM ex e LEFT JOIN fx ON fx.USUBJID = e.USUBJID LEFT JOIN on1 ON on1.USUBJID = e.USUBJID"""),
    "A04": ("RS", RS, WHO + V0 + "SELECT r.USUBJID, r.VISITNUM + CASE WHEN v0.v IS NOT NULL THEN 0.5 ELSE 0 END AS VISITNUM, r.RSSEQ, r.RSTESTCD, r.RSORRES FROM rs r LEFT JOIN v0 ON v0.USUBJID = r.USUBJID AND v0.v = r.VISITNUM"),
    "A05": ("SUPPDM", ("USUBJID", "QNAM", "QVAL"), "SELECT USUBJID, QNAM, QVAL FROM suppdm UNION ALL SELECT DISTINCT USUBJID, 'SEX', CASE WHEN SEX = 'F' THEN 'M' ELSE 'F' END FROM dm"),
    "A06": ("TR", ("TRSPID", "TRORRES"), WHO + SD + _tr_at("sd")),
    "A07": ("RS", RS, WHO + f""", p AS (SELECT USUBJID, bool_or(RSORRES = 'PR') AS had,
        coalesce(arg_min(struct_pack(v := VISITNUM, d := RSDTC), struct_pack(a := VISITNUM, b := RSSEQ)) FILTER (WHERE RSORRES = 'PR'),
                 arg_min(struct_pack(v := VISITNUM, d := RSDTC), struct_pack(a := VISITNUM, b := RSSEQ))) AS c FROM rs WHERE USUBJID IN (FROM who) GROUP BY ALL)
      SELECT {RSC}, CASE WHEN p.USUBJID IS NOT NULL AND NOT p.had THEN 'PR' ELSE r.RSORRES END AS RSORRES FROM rs r LEFT JOIN p ON p.USUBJID = r.USUBJID
      WHERE p.USUBJID IS NULL OR r.VISITNUM <= p.c.v OR r.RSDTC <= {_shift('p.c.d', 28)}"""),
    "A08": _dm("ARMCD", "'TRTARMX'"),
    "A09": ("DS", ("USUBJID", "DSDECOD"), WHO_AE + "SELECT USUBJID, DSDECOD FROM ds WHERE USUBJID NOT IN (FROM who)"),
    "A10": _dm("RFXSTDTC", f"coalesce({_shift('x.a', -7)}, d.RFXSTDTC)", XJ),
    "A11": _dm("RFXENDTC", f"coalesce({_shift('x.b', 7)}, d.RFXENDTC)", XJ),
    "A12": _dm("DTHFL", "'Y'"),
    "A13": _dm("RACE", "'MULTIPLE'"),
    "A14": ("RELREC", ("RDOMAIN", "USUBJID", "RELID"), WHO_AE + "SELECT RDOMAIN, USUBJID, RELID FROM relrec WHERE NOT (RDOMAIN = 'EX' AND USUBJID IN (FROM who))"),
    "A15": _dm("RFSTDTC", f"coalesce({_shift('x.a', -5)}, d.RFSTDTC)", XJ),
    "A16": ("DM", ("STUDYID", "USUBJID"), "SELECT STUDYID, USUBJID FROM dm UNION ALL SELECT DISTINCT 'DUPLICATE_STUDY', USUBJID FROM dm"),
    "A17": ("DM", ("STUDYID", "USUBJID", "ARM"), """, mine AS (SELECT USUBJID, arg_min(ARMCD, STUDYID) AS a FROM dm WHERE ARMCD IS NOT NULL GROUP BY ALL),
      peer AS (SELECT DISTINCT coalesce((SELECT min(o.USUBJID) FROM dm o WHERE o.ARMCD = mine.a AND o.USUBJID <> mine.USUBJID), mine.USUBJID) AS p FROM mine)
      SELECT STUDYID, USUBJID, CASE WHEN USUBJID IN (FROM peer) THEN 'CONFLICTING ARM NAME' ELSE ARM END AS ARM FROM dm"""),
    "A18": ("RS", RS, WHO + V0 + _rs_at("v0", "SD")),
    "A19": ("RS", RS, WHO + V0 + _rs_at("v0", "CR")),
    "A20": ("RS", (*RS, "RSDTC"), WHO + f""", l AS (SELECT USUBJID, max(VISITNUM) + 1 AS v, arg_min(struct_pack(q := RSSEQ, t := RSTESTCD, d := RSDTC), struct_pack(a := VISITNUM, b := RSSEQ)) AS f FROM rs
      WHERE USUBJID IN (FROM who) GROUP BY ALL)
      SELECT USUBJID, VISITNUM, RSSEQ, RSTESTCD, RSORRES, RSDTC FROM rs UNION ALL SELECT USUBJID, v, f.q, f.t, 'iCPD', {_shift('f.d', 56)} FROM l"""),
    "VA07": ("RS", RS, WHO + f""", s AS (SELECT USUBJID, min(VISITNUM) AS a, max(VISITNUM) AS z FROM rs WHERE RSTESTCD = 'OVRLRESP' AND USUBJID IN (FROM who) GROUP BY ALL)
      SELECT {RSC}, CASE WHEN s.z > s.a AND r.RSTESTCD = 'OVRLRESP' THEN CASE WHEN r.VISITNUM = s.a THEN 'PR' ELSE 'SD' END ELSE r.RSORRES END AS RSORRES FROM rs r LEFT JOIN s ON s.USUBJID = r.USUBJID"""),
    "VA20": ("RS", RS, WHO + """, l AS (SELECT USUBJID, max(VISITNUM) + 1 AS v, max(RSSEQ) + 1 AS q FROM rs WHERE USUBJID IN (FROM who) GROUP BY ALL HAVING bool_or(RSTESTCD = 'OVRLRESP'))
      SELECT USUBJID, VISITNUM, RSSEQ, RSTESTCD, RSORRES FROM rs UNION ALL SELECT USUBJID, v, q, 'OVRLRESP', 'iCPD' FROM l"""),
    # H01 changes responses as A01 does and then adds the lesion at the first SD visit that is left
    "H01": ("TU", TU, WHO + SLD1 + ", r1 AS (" + _rs_at("m1", "PD") + """), sd AS (SELECT USUBJID, coalesce(min(VISITNUM) FILTER (WHERE RSORRES = 'SD'), min(VISITNUM)) AS v FROM r1
      WHERE USUBJID IN (FROM who) GROUP BY ALL)""" + TUN + NEW_TU),
    "H02": _dm("RFICDTC", _shift("coalesce(x.a, '2014-01-01')", 14), XJ),
    "H03": ("TR", ("TRSPID", "TRSTRESN"), WHO + V0 + "SELECT t.TRSPID, CASE WHEN v0.v IS NOT NULL AND t.TRTESTCD = 'LDIAM' THEN 25.0 ELSE t.TRSTRESN END AS TRSTRESN FROM tr t LEFT JOIN v0 ON v0.USUBJID = t.USUBJID AND v0.v = t.VISITNUM"),
    "H04": ("TR", ("TRSPID", "VISITNUM", "TRTESTCD", "TRORRES"), WHO + V0 + """, has AS (SELECT DISTINCT t.USUBJID FROM tr t JOIN v0 ON v0.USUBJID = t.USUBJID AND v0.v = t.VISITNUM WHERE t.TRTESTCD = 'TUMSTATE'),
      la AS (SELECT USUBJID, arg_max(TRSPID, struct_pack(a := VISITNUM, b := TRLNKID, c := TRSPID)) AS k FROM tr GROUP BY ALL)
      SELECT t.TRSPID, t.VISITNUM, t.TRTESTCD, CASE WHEN v0.v IS NOT NULL AND t.TRTESTCD = 'TUMSTATE' THEN 'UNEQUIVOCAL PROGRESSION' ELSE t.TRORRES END AS TRORRES
      FROM tr t LEFT JOIN v0 ON v0.USUBJID = t.USUBJID AND v0.v = t.VISITNUM
      UNION ALL SELECT la.k, v0.v, 'TUMSTATE', 'UNEQUIVOCAL PROGRESSION' FROM v0 JOIN la USING (USUBJID) WHERE v0.USUBJID NOT IN (FROM has)"""),
    "H05": _dm("ARMCD", "CASE WHEN x.USUBJID IS NOT NULL THEN '' ELSE d.ARMCD END", XJ),
}


def _injected(name, domain, columns):
    def run(spark, sf):
        st = study(spark, sf)
        who = st["AE" if name in ("A09", "A14") else "DM"].select("USUBJID")
        changed, _manifest = ij.inject(st, name, who)
        return changed[domain].select(*columns)
    return run


for _name, (_domain, _columns, _sql) in CASES.items():
    Q[f"INJ-{_name}"] = _injected(_name, _domain, _columns)
    O[f"INJ-{_name}"] = stored(PRELUDE + _sql)


def query(name: str, sql: str = ""):
    def add(fn):
        Q[name] = lambda spark, sf: fn(study(spark, sf), spark, sf)
        if sql:
            O[name] = PRELUDE + sql
        return fn
    return add


@query("INJ-REL", "SELECT RDOMAIN, USUBJID, RELID FROM relrec WHERE NOT (RDOMAIN = 'AE' AND USUBJID IN (SELECT USUBJID FROM ds WHERE DSDECOD = 'DEATH'))")
def _(st, spark, sf):
    who = st["DS"].filter("DSDECOD = 'DEATH'").select("USUBJID").distinct()
    return ij.drop_relations(st, "AE", who)["RELREC"].select("RDOMAIN", "USUBJID", "RELID")


@query("INJ-DROP", """SELECT 'TR' AS domain, count(*) AS before, count(*) - CAST(round(count(*) * 0.25) AS BIGINT) AS after FROM tr
  UNION ALL SELECT 'RS', count(*), count(*) - CAST(round(count(*) * 0.25) AS BIGINT) FROM rs UNION ALL SELECT 'TU', count(*), count(*) - CAST(round(count(*) * 0.25) AS BIGINT) FROM tu""")
def _(st, spark, sf):
    less = ij.drop_fraction(st, 0.25, seed=7)
    out = None
    for d in ("TR", "RS", "TU"):
        before = st.raw(d).agg(F.count(F.lit(1)).alias("before")).withColumn("domain", F.lit(d))
        part = before.join(less.raw(d).agg(F.count(F.lit(1)).alias("after")).withColumn("domain", F.lit(d)), "domain")
        out = part if out is None else out.unionByName(part)
    return out


@query("INJ-FK", """SELECT (SELECT CAST(floor(count(*) * 0.15) AS BIGINT) FROM tr) AS orphan_links, CAST(1 AS BIGINT) AS ghosts,
  (SELECT count(*) - CAST(floor(count(*) * 0.15) AS BIGINT) FROM tu) AS lesions""")
def _(st, spark, sf):
    broken = ij.orphan_keys(st, 0.15, seed=7)
    one = F.lit(1).alias("_k")
    a = broken.raw("TR").agg(F.count_if(F.col("TRLNKID") == "ORPHAN-LESION-ZZZ").alias("orphan_links")).select(one, "orphan_links")
    b = broken.raw("RS").agg(F.count_if(F.col("USUBJID") == "GHOST-SUBJECT-000").alias("ghosts")).select(one, "ghosts")
    c = broken.raw("TU").agg(F.count(F.lit(1)).alias("lesions")).select(one, "lesions")
    return a.join(b, "_k").join(c, "_k").drop("_k")


@query("INJ-VIS", """SELECT (SELECT sum(VISITNUM) + 0.5 * floor(count(*) * 0.15) FROM tr) AS tr_total, (SELECT sum(VISITNUM) + 0.5 * floor(count(*) * 0.15) FROM rs) AS rs_total""")
def _(st, spark, sf):
    moved = ij.fractional_visits(st, 0.15, seed=7)
    one = F.lit(1).alias("_k")
    a = moved.raw("TR").agg(F.sum("VISITNUM").alias("tr_total")).select(one, "tr_total")
    return a.join(moved.raw("RS").agg(F.sum("VISITNUM").alias("rs_total")).select(one, "rs_total"), "_k").drop("_k")


CO = """, det AS (SELECT DISTINCT USUBJID, concat('A', lpad(CAST(RSSEQ % 20 + 1 AS VARCHAR), 2, '0')) AS archetype FROM rs)
"""


def _detectable(st):
    return st["RS"].select("USUBJID", F.concat(F.lit("A"), F.lpad((F.col("RSSEQ") % 20 + 1).cast("bigint").cast("string"), 2, "0")).alias("archetype")).distinct()


@query("INJ-CO", CO + """SELECT USUBJID, archetype FROM det WHERE archetype NOT IN ('A01','A02','A04','A06','A07','A18','A20')
  UNION ALL SELECT USUBJID, min(archetype) FROM det WHERE archetype IN ('A01','A02','A04','A06','A07','A18','A20') GROUP BY USUBJID""")
def _(st, spark, sf):
    return ij.compatible_set(_detectable(st), ["USUBJID"])


@query("INJ-PICK", "SELECT USUBJID FROM (SELECT DISTINCT USUBJID FROM rs) WHERE USUBJID IN (SELECT USUBJID FROM ds)")
def _(st, spark, sf):
    return ij.pick(st, "RS", st["DS"].select("USUBJID").distinct())


@query("INJ-MAN", WHO + "SELECT USUBJID, 'A06' AS archetype, 'RS,TR' AS domains_modified FROM who")
def _(st, spark, sf):
    return ij.inject(st, "A06", st["DM"].select("USUBJID"))[1]


@query("EV19", WHO + V0 + """, a AS (SELECT USUBJID, VISITNUM, RSSEQ, RSORRES FROM rs), b AS (
    SELECT r.USUBJID, r.VISITNUM, r.RSSEQ, CASE WHEN v0.v IS NOT NULL THEN 'CR' ELSE r.RSORRES END AS RSORRES FROM rs r LEFT JOIN v0 ON v0.USUBJID = r.USUBJID AND v0.v = r.VISITNUM)
  SELECT *, CAST(-1 AS BIGINT) AS difference FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 1 FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(st, spark, sf):
    cols = ("USUBJID", "VISITNUM", "RSSEQ", "RSORRES")
    changed, _m = ij.inject(st, "A19", st["DM"].select("USUBJID"))
    return fs.changed_rows(st["RS"].select(*cols), changed["RS"].select(*cols))


@query("H05-INJECTED", "SELECT USUBJID AS subject, 'H05' AS rule_id, 'violation' AS severity FROM dm WHERE USUBJID IN (SELECT USUBJID FROM ex)")
def _(st, spark, sf):
    # blank arms for every exposed subject, so that the probe has something to find
    changed, _m = ij.inject(st, "H05", st["DM"].select("USUBJID"))
    return run_checks(changed, ["H05"]).select("subject", "rule_id", "severity")


def queries() -> dict:
    return Q


def oracle() -> dict:
    return O
