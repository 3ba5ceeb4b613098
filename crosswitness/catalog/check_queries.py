"""Registered check queries with literal EXISTS / NOT EXISTS counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crosswitness.catalog.testbed import PRELUDE, study
from crosswitness.plans.checks import ARCHETYPES, DERIVATIONS, PROBES, run_checks

FLAT = ("subject", "visit", "layer", "archetype", "rule_id", "domain", "record_id", "severity")

DM_CELLS = ("STUDYID", "USUBJID", "AGE", "AGEU", "SEX", "RACE", "ARMCD", "ARM", "ACTARMCD", "DTHFL", "RFSTDTC",
            "RFXSTDTC", "RFXENDTC", "RFICDTC", "ACTARM", "DTHDTC", "ETHNIC")
CELLS = {"DM": DM_CELLS, "TU": ("USUBJID", "TULNKID", "VISITNUM", "TUCAT"), "SUPPDM": ("USUBJID", "QNAM", "QVAL")}
KEYS = {"RS": "RSSEQ", "TR": "TRSPID", "EX": "EXSEQ", "AE": "AESEQ"}


def key_sql(domain: str, alias: str = "t") -> str:
    if domain in KEYS:
        return f"CAST({alias}.{KEYS[domain]} AS VARCHAR)"
    cells = ", ".join(f"coalesce(CAST({alias}.{c} AS VARCHAR), '')" for c in CELLS[domain])
    return f"substr(md5(concat_ws('|', {cells})), 1, 12)"


def record_sql(domain: str, alias: str = "t") -> str:
    return f"concat('{domain}/', {alias}.USUBJID, '/', {key_sql(domain, alias)})"


def flag_sql(rule: str, domain: str, where: str, severity: str = "violation", layer: str = "L1") -> str:
    visit = "CAST(t.VISITNUM AS VARCHAR)" if domain in ("RS", "TR", "TU") else "CAST(NULL AS VARCHAR)"
    archetype = rule if rule[0] in "AH" else f"DERIVATION-{rule}"
    return (
        f"SELECT t.USUBJID AS subject, {visit} AS visit, '{layer}' AS layer, '{archetype}' AS archetype, "
        f"'{rule}' AS rule_id, '{domain}' AS domain, {record_sql(domain)} AS record_id, '{severity}' AS severity "
        f"FROM {domain.lower()} t WHERE {where}"
    )


OVR = "t.RSTESTCD = 'OVRLRESP'"
TGT = "t.RSCAT = 'TARGET RESPONSE' AND t.RSTESTCD = 'OVRESP'"
AT = "x.USUBJID = t.USUBJID AND x.VISITNUM = t.VISITNUM"
SUM = f"(SELECT sum(CAST(x.TRSTRESN AS DECIMAL(18, 6))) FROM tr x WHERE x.TRTESTCD = 'LDIAM' AND x.TRTARGETLN AND {AT})"
BL = "(SELECT min(b.VISITNUM) FROM tr b WHERE b.TRTARGETLN AND b.EPOCH = 'SCREENING' AND b.USUBJID = t.USUBJID)"
TRV = """, trv AS (SELECT USUBJID, VISITNUM, sum(CAST(TRSTRESN AS DECIMAL(18, 6))) AS sld FROM tr
  WHERE TRTESTCD = 'LDIAM' AND TRTARGETLN GROUP BY USUBJID, VISITNUM),
bl AS (SELECT USUBJID, min(VISITNUM) AS bv FROM tr WHERE TRTARGETLN AND EPOCH = 'SCREENING' GROUP BY USUBJID),
meas AS (SELECT s.USUBJID, s.VISITNUM, s.sld, bl.bv,
    (SELECT b.sld FROM trv b WHERE b.USUBJID = s.USUBJID AND b.VISITNUM = bl.bv) AS base,
    (SELECT min(n.sld) FROM trv n WHERE n.USUBJID = s.USUBJID AND n.VISITNUM >= bl.bv AND n.VISITNUM <= s.VISITNUM) AS nadir
  FROM trv s JOIN bl ON bl.USUBJID = s.USUBJID),
fresh AS (SELECT x.USUBJID, x.VISITNUM FROM tu x JOIN bl ON bl.USUBJID = x.USUBJID
  WHERE x.TUCAT = 'TARGET LESION' AND x.VISITNUM > bl.bv AND NOT EXISTS (
    SELECT 1 FROM tu p WHERE p.USUBJID = x.USUBJID AND p.TULNKID = x.TULNKID AND p.VISITNUM <= bl.bv))
"""


def meas(cond: str) -> str:
    return f"EXISTS (SELECT 1 FROM meas x WHERE {AT} AND t.VISITNUM > x.bv AND {cond})"


def no_row(table: str, cond: str = "") -> str:
    return f"NOT EXISTS (SELECT 1 FROM {table} x WHERE x.USUBJID = t.USUBJID{cond})"


ASSIGNED = "t.ACTARMCD NOT IN ('', 'Scrnfail')"
PROGRESSION = "t.TRTESTCD = 'TUMSTATE' AND contains(upper(t.TRORRES), 'UNEQUIVOCAL PROGRESSION')"
WHERE = {
    "A01": ("RS", f"""{OVR} AND t.RSORRES = 'PD' AND EXISTS (
        SELECT 1 FROM tr x JOIN tr b ON b.USUBJID = x.USUBJID AND b.TRLNKID = x.TRLNKID
        WHERE {AT} AND x.TRTESTCD = 'LDIAM' AND b.TRTESTCD = 'LDIAM' AND b.VISITNUM < x.VISITNUM
          AND CAST(x.TRSTRESN AS DECIMAL(18, 6)) < 0.70 * CAST(b.TRSTRESN AS DECIMAL(18, 6)) AND NOT EXISTS (
            SELECT 1 FROM tr m WHERE m.USUBJID = x.USUBJID AND m.TRLNKID = x.TRLNKID AND m.TRTESTCD = 'LDIAM'
              AND m.VISITNUM > b.VISITNUM AND m.VISITNUM < x.VISITNUM))"""),
    "A02": ("TU", f"""EXISTS (SELECT 1 FROM rs x WHERE {AT} AND x.RSTESTCD = 'OVRLRESP' AND x.RSORRES <> 'PD')
        AND NOT EXISTS (SELECT 1 FROM tu e WHERE e.USUBJID = t.USUBJID AND e.TULNKID = t.TULNKID AND e.VISITNUM < t.VISITNUM)"""),
    "A03": ("EX", """length(t.EXSTDTC) >= 10 AND NOT EXISTS (SELECT 1 FROM ex e WHERE e.USUBJID = t.USUBJID
            AND length(e.EXSTDTC) >= 10 AND e.EXSTDTC < t.EXSTDTC)
        AND EXISTS (SELECT 1 FROM ae x WHERE x.USUBJID = t.USUBJID AND x.AEREL IN ('PROBABLE', 'POSSIBLE', 'Y')
            AND length(x.AESTDTC) >= 10
            AND date_diff('day', CAST(x.AESTDTC AS DATE), CAST(t.EXSTDTC AS DATE)) > 7)"""),
    "A04": ("RS", "t.VISITNUM <> floor(t.VISITNUM)"),
    "A05": ("SUPPDM", "t.QNAM = 'SEX' AND EXISTS (SELECT 1 FROM dm x WHERE x.USUBJID = t.USUBJID AND x.SEX <> t.QVAL)"),
    "A06": ("TR", f"{PROGRESSION} AND EXISTS (SELECT 1 FROM rs x WHERE {AT} AND x.RSTESTCD = 'OVRLRESP' AND x.RSORRES = 'SD')"),
    "A07": ("RS", f"""{OVR} AND t.RSORRES = 'PR' AND t.RSDTC IS NOT NULL
        AND EXISTS (SELECT 1 FROM rs x WHERE x.USUBJID = t.USUBJID AND x.VISITNUM > t.VISITNUM)
        AND NOT EXISTS (SELECT 1 FROM rs x WHERE x.USUBJID = t.USUBJID AND x.RSTESTCD = 'OVRLRESP'
            AND x.VISITNUM > t.VISITNUM AND x.RSORRES IN ('PR', 'CR'))""", "warning"),
    "A08": ("DM", "t.ARMCD NOT IN ('', 'Scrnfail') AND NOT EXISTS (SELECT 1 FROM ta x WHERE x.ARMCD = t.ARMCD)"),
    "A09": ("DM", f"{ASSIGNED} AND {no_row('ds')}"),
    "A10": ("DM", f"t.RFXSTDTC <> '' AND {no_row('ex', ' AND x.EXSTDTC = t.RFXSTDTC')}"),
    "A11": ("DM", f"t.RFXENDTC <> '' AND {no_row('ex', ' AND x.EXENDTC = t.RFXENDTC')}"),
    "A12": ("DM", "t.DTHFL = 'Y' AND " + no_row("ds", " AND contains(upper(x.DSDECOD), 'DEATH')")),
    "A13": ("DM", "t.RACE = 'MULTIPLE' AND " + no_row("suppdm", " AND contains(upper(x.QNAM), 'RACE')")),
    "A14": ("DM", f"{ASSIGNED} AND {no_row('ex')}"),
    "A15": ("DM", f"t.RFSTDTC <> '' AND {no_row('ex', ' AND x.EXSTDTC = t.RFSTDTC')}"),
    "A16": ("DM", "(SELECT count(*) FROM dm x WHERE x.USUBJID = t.USUBJID) > 1"),
    "A17": ("DM", "EXISTS (SELECT 1 FROM dm x WHERE x.ARMCD = t.ARMCD AND x.ARM <> t.ARM)"),
    "A18": ("TR", f"{PROGRESSION} AND EXISTS (SELECT 1 FROM rs x WHERE {AT} AND x.RSTESTCD = 'OVRLRESP' AND x.RSORRES <> 'PD')"),
    "A20": ("RS", f"""{OVR} AND t.RSORRES = 'iCPD' AND NOT EXISTS (SELECT 1 FROM rs x WHERE x.USUBJID = t.USUBJID
        AND x.RSTESTCD = 'OVRLRESP' AND x.RSORRES = 'iCPD' AND x.VISITNUM > t.VISITNUM)"""),
    "S1": ("RS", f"t.RSCAT = 'TARGET RESPONSE' AND t.RSTESTCD = 'SUMDIAM' AND {SUM} <> CAST(t.RSSTRESN AS DECIMAL(18, 6))"),
    "S2": ("RS", f"""{TGT} AND t.RSORRES <> 'CR'
        AND EXISTS (SELECT 1 FROM tr x WHERE {AT} AND x.TRTESTCD = 'LDIAM' AND x.TRTARGETLN AND x.TRSTRESN IS NOT NULL)
        AND NOT EXISTS (SELECT 1 FROM tr x WHERE {AT} AND x.TRTESTCD = 'LDIAM' AND x.TRTARGETLN AND x.TRSTRESN > 0)
        AND NOT EXISTS (SELECT 1 FROM tr x WHERE {AT} AND x.TRTESTCD = 'LNSADIAM' AND x.TRTARGETLN AND x.TRSTRESN >= 10)"""),
    "S3": ("RS", f"{TGT} AND t.RSORRES NOT IN ('PR', 'CR') AND " + meas("x.sld <= 0.70 * x.base")),
    "S4": ("RS", f"{TGT} AND t.RSORRES <> 'PD' AND " + meas("x.sld >= 1.20 * x.nadir AND x.sld - x.nadir >= 5")),
    "S5": ("RS", f"{TGT} AND t.RSORRES <> 'SD' AND "
           + meas("x.sld > 0.70 * x.base AND (x.sld < 1.20 * x.nadir OR x.sld - x.nadir < 5)")
           + f" AND NOT EXISTS (SELECT 1 FROM fresh x WHERE {AT})"),
    "S6": ("RS", f"{TGT} AND t.RSORRES <> 'PD' AND EXISTS (SELECT 1 FROM fresh x WHERE {AT})"),
    "S7": ("RS", f"""{TGT} AND t.RSORRES IN ('CR', 'PR') AND t.RSDTC IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM rs x WHERE x.USUBJID = t.USUBJID AND x.RSCAT = 'TARGET RESPONSE'
            AND x.RSTESTCD = 'OVRESP' AND x.RSORRES IN ('CR', 'PR')
            AND date_diff('day', CAST(t.RSDTC AS DATE), CAST(x.RSDTC AS DATE)) >= 28)""", "warning"),
    "S8": ("RS", f"""{TGT} AND t.RSORRES <> 'NE' AND t.VISITNUM > {BL}
        AND NOT EXISTS (SELECT 1 FROM tr x WHERE {AT} AND x.TRTESTCD = 'LDIAM' AND x.TRTARGETLN AND x.TRSTRESN >= 0)"""),
    "H02": ("DM", "t.RFICDTC <> '' AND EXISTS (SELECT 1 FROM ex x WHERE x.USUBJID = t.USUBJID AND x.EXSTDTC <> '' AND x.EXSTDTC < t.RFICDTC)"),
    "H03": ("RS", f"{OVR} AND t.RSORRES = 'CR' AND EXISTS (SELECT 1 FROM tr x WHERE {AT} AND x.TRTESTCD = 'LDIAM' AND x.TRSTRESN > 0)"),
    "H05": ("DM", "coalesce(t.ARMCD, '') = '' AND coalesce(t.ACTARMCD, '') = '' AND EXISTS (SELECT 1 FROM ex x WHERE x.USUBJID = t.USUBJID)"),
}

LOOKUP_SQL = """, lookup(tgt, nt, nl, expected) AS (VALUES
  ('CR','CR','NO','CR'), ('CR','NON-CR/NON-PD','NO','PR'), ('CR','PD','NO','PD'), ('CR','NE','NO','PR'),
  ('PR','CR','NO','PR'), ('PR','NON-CR/NON-PD','NO','PR'), ('PR','PD','NO','PD'), ('PR','NE','NO','PR'),
  ('SD','CR','NO','SD'), ('SD','NON-CR/NON-PD','NO','SD'), ('SD','PD','NO','PD'), ('SD','NE','NO','SD'),
  ('NE','CR','NO','NE'), ('NE','NON-CR/NON-PD','NO','NE'), ('NE','PD','NO','PD'), ('NE','NE','NO','NE'),
  ('CR','CR','YES','PD'), ('CR','NON-CR/NON-PD','YES','PD'), ('CR','PD','YES','PD'), ('CR','NE','YES','PD'),
  ('PR','CR','YES','PD'), ('PR','NON-CR/NON-PD','YES','PD'), ('PR','PD','YES','PD'), ('PR','NE','YES','PD'),
  ('PD','CR','YES','PD'), ('PD','NON-CR/NON-PD','YES','PD'), ('PD','PD','YES','PD'), ('PD','NE','YES','PD'),
  ('SD','CR','YES','PD'), ('SD','NON-CR/NON-PD','YES','PD'), ('SD','NE','YES','PD'),
  ('NE','CR','YES','PD'), ('NE','NON-CR/NON-PD','YES','PD'), ('NE','NE','YES','PD'))
"""
A19_WHERE = f"""{OVR} AND EXISTS (SELECT 1 FROM rs n, rs w, lookup k
  WHERE n.USUBJID = t.USUBJID AND n.RSTESTCD = 'NTOVRLRESP' AND w.USUBJID = t.USUBJID AND w.RSTESTCD = 'NEWLEC'
    AND k.tgt = CASE WHEN t.RSORRES = 'NON-CR/NON-PD' THEN 'SD' ELSE upper(t.RSORRES) END AND k.nt = n.RSORRES
    AND k.nl = CASE WHEN w.RSORRES = 'Y' THEN 'YES' ELSE 'NO' END AND k.expected <> upper(t.RSORRES))"""
A19_SUBJECT_SQL = PRELUDE + LOOKUP_SQL + """, f AS (
  SELECT USUBJID, RSTESTCD, RSORRES, VISITNUM, row_number() OVER (PARTITION BY USUBJID, RSTESTCD ORDER BY VISITNUM, RSSEQ) AS n FROM rs)
SELECT o.USUBJID AS subject, CAST(o.VISITNUM AS VARCHAR) AS visit, 'L3' AS layer, 'A19' AS archetype, 'A19' AS rule_id, 'RS' AS domain,
       concat('RS/', o.USUBJID) AS record_id, 'violation' AS severity
FROM f o JOIN f n ON n.USUBJID = o.USUBJID AND n.RSTESTCD = 'NTOVRLRESP' AND n.n = 1
LEFT JOIN f w ON w.USUBJID = o.USUBJID AND w.RSTESTCD = 'NEWLEC' AND w.n = 1
JOIN lookup k ON k.tgt = upper(o.RSORRES) AND k.nt = n.RSORRES AND k.nl = CASE WHEN w.RSORRES = 'Y' THEN 'YES' ELSE 'NO' END
WHERE o.RSTESTCD = 'OVRLRESP' AND o.n = 1 AND k.expected <> upper(o.RSORRES)
"""


def check_sql(rule: str) -> str:
    if rule == "A19":
        return flag_sql("A19", "RS", A19_WHERE, layer="L3")
    domain, where, *rest = WHERE[rule]
    return flag_sql(rule, domain, where, *rest)


def flat(flags: DataFrame) -> DataFrame:
    return flags.select(*FLAT)


ALL = (*ARCHETYPES, *DERIVATIONS)


def queries() -> dict:
    out = {i: (lambda spark, sf, i=i: flat(run_checks(study(spark, sf), [i]))) for i in (*ALL, *PROBES)}
    out["A19-SUBJECT"] = lambda spark, sf: flat(run_checks(study(spark, sf), ["A19"], lookup_grain="subject"))
    out["ALL-CHECKS"] = lambda spark, sf: flat(run_checks(study(spark, sf), ALL))
    return out


def oracle() -> dict:
    out = {i: PRELUDE + TRV + LOOKUP_SQL + check_sql(i) for i in (*ALL, *PROBES)}
    out["A19-SUBJECT"] = A19_SUBJECT_SQL
    out["ALL-CHECKS"] = PRELUDE + TRV + LOOKUP_SQL + " UNION ALL ".join(check_sql(i) for i in ALL)
    return out


def flags_cte(ids=ALL, name: str = "flags") -> str:
    """CTE text holding the flags of several checks, to follow PRELUDE."""
    return TRV + LOOKUP_SQL + f", {name} AS (" + " UNION ALL ".join(check_sql(i) for i in ids) + ")\n"
