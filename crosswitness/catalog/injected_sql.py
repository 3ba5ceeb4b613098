"""SQL of whole tables after each injection into every subject, for the detection queries."""

from __future__ import annotations

import re

from crosswitness.catalog.check_queries import LOOKUP_SQL, TRV, check_sql
from crosswitness.catalog.injection_queries import EXS, SD, SLD1, TUN, V0, WHO, _shift
from crosswitness.catalog.sqltext import stored
from crosswitness.catalog.testbed import PRELUDE
from crosswitness.plans.differential import LOCAL, affected

AT = "ON m.USUBJID = r.USUBJID AND m.v = r.VISITNUM"
MARKS = WHO + V0 + SD + SLD1 + TUN + EXS + """, on1 AS (SELECT USUBJID, coalesce(arg_min(AESTDTC, AESEQ) FILTER (WHERE AEREL = 'Y'), arg_min(AESTDTC, AESEQ)) AS o FROM ae GROUP BY ALL),
  e1 AS (SELECT USUBJID, min(EXSEQ) AS s FROM ex GROUP BY ALL),
  p7 AS (SELECT USUBJID, bool_or(RSORRES = 'PR') AS had,
      coalesce(arg_min(struct_pack(v := VISITNUM, d := RSDTC), struct_pack(a := VISITNUM, b := RSSEQ)) FILTER (WHERE RSORRES = 'PR'),
               arg_min(struct_pack(v := VISITNUM, d := RSDTC), struct_pack(a := VISITNUM, b := RSSEQ))) AS c FROM rs GROUP BY ALL),
  one AS (SELECT DISTINCT ON (USUBJID) * FROM dm ORDER BY USUBJID, STUDYID),
  r1 AS (SELECT DISTINCT ON (USUBJID) * FROM rs ORDER BY USUBJID, VISITNUM, RSSEQ),
  ov AS (SELECT USUBJID, min(VISITNUM) AS a, max(VISITNUM) AS z FROM rs WHERE RSTESTCD = 'OVRLRESP' GROUP BY ALL),
  o9 AS (SELECT DISTINCT ON (USUBJID) * FROM rs WHERE RSTESTCD = 'OVRLRESP' ORDER BY USUBJID, VISITNUM DESC, RSSEQ DESC),
  top AS (SELECT USUBJID, max(VISITNUM) + 1 AS v, max(RSSEQ) + 1 AS q FROM rs GROUP BY ALL),
  t9 AS (SELECT DISTINCT ON (USUBJID) * FROM tr ORDER BY USUBJID, VISITNUM DESC, TRLNKID DESC, TRSPID DESC),
  has AS (SELECT DISTINCT t.USUBJID FROM tr t JOIN v0 ON v0.USUBJID = t.USUBJID AND v0.v = t.VISITNUM WHERE t.TRTESTCD = 'TUMSTATE')
"""


def _rs(marks: str, value: str, cond: str = "TRUE") -> str:
    return f"SELECT r.* REPLACE (CASE WHEN m.v IS NOT NULL AND {cond} THEN '{value}' ELSE r.RSORRES END AS RSORRES) FROM rs r LEFT JOIN {marks} m {AT}"


def _progress(marks: str) -> str:
    return f"SELECT r.* REPLACE (CASE WHEN m.v IS NOT NULL AND r.TRTESTCD = 'TUMSTATE' THEN 'UNEQUIVOCAL PROGRESSION' ELSE r.TRORRES END AS TRORRES) FROM tr r LEFT JOIN {marks} m {AT}"


def _dm(col: str, expr: str) -> dict:
    return {"dm": f"SELECT d.* REPLACE ({expr} AS {col}) FROM dm d LEFT JOIN xs x ON x.USUBJID = d.USUBJID"}


def _new_lesion(at: str) -> str:
    return f"SELECT USUBJID, TULNKID, VISITNUM, TUCAT FROM tu UNION ALL SELECT USUBJID, concat('T', lpad(CAST(n + 1 AS VARCHAR), 2, '0')), {at}.v, cat FROM ln JOIN {at} USING (USUBJID)"


def _moved(table: str) -> str:
    return f"SELECT r.* REPLACE (r.VISITNUM + CASE WHEN m.v IS NOT NULL THEN 0.5 ELSE 0 END AS VISITNUM) FROM {table} r LEFT JOIN v0 m {AT}"


CHANGED: dict[str, dict[str, str]] = {
    "A01": {"rs": _rs("m1", "PD")},
    "A02": {"tu": _new_lesion("sd")},
    "A03": {"ex": f"SELECT r.* REPLACE (CASE WHEN e1.s = r.EXSEQ AND o IS NOT NULL THEN {_shift('o', 14)} ELSE r.EXSTDTC END AS EXSTDTC) FROM ex r LEFT JOIN e1 ON e1.USUBJID = r.USUBJID LEFT JOIN on1 ON on1.USUBJID = r.USUBJID"},
    "A04": {"rs": _moved("rs"), "tr": _moved("tr")},
    "A05": {"suppdm": "SELECT USUBJID, QNAM, QVAL FROM suppdm UNION ALL SELECT USUBJID, 'SEX', CASE WHEN SEX = 'F' THEN 'M' ELSE 'F' END FROM one"},
    "A06": {"rs": _rs("sd", "SD", "NOT m.had"), "tr": _progress("sd")},
    "A07": {"rs": f"SELECT r.* REPLACE (CASE WHEN NOT p.had THEN 'PR' ELSE r.RSORRES END AS RSORRES) FROM rs r JOIN p7 p ON p.USUBJID = r.USUBJID WHERE r.VISITNUM <= p.c.v OR r.RSDTC <= {_shift('p.c.d', 28)}"},
    "A08": _dm("ARMCD", "'TRTARMX'"),
    "A09": {"ds": "SELECT * FROM ds WHERE FALSE", "relrec": "SELECT * FROM relrec WHERE RDOMAIN <> 'DS'"},
    "A10": _dm("RFXSTDTC", f"coalesce({_shift('x.a', -7)}, d.RFXSTDTC)"),
    "A11": _dm("RFXENDTC", f"coalesce({_shift('x.b', 7)}, d.RFXENDTC)"),
    "A12": _dm("DTHFL", "'Y'"),
    "A13": _dm("RACE", "'MULTIPLE'"),
    "A14": {"ex": "SELECT * FROM ex WHERE FALSE", "relrec": "SELECT * FROM relrec WHERE RDOMAIN <> 'EX'"},
    "A15": _dm("RFSTDTC", f"coalesce({_shift('x.a', -5)}, d.RFSTDTC)"),
    "A16": {"dm": "SELECT * FROM dm UNION ALL SELECT * REPLACE ('DUPLICATE_STUDY' AS STUDYID) FROM one"},
    "A18": {"rs": _rs("v0", "SD"), "tr": _progress("v0")},
    "A19": {"rs": _rs("v0", "CR")},
    "A20": {"rs": f"SELECT * FROM rs UNION ALL SELECT r1.* REPLACE (top.v AS VISITNUM, 'iCPD' AS RSORRES, {_shift('r1.RSDTC', 56)} AS RSDTC) FROM r1 JOIN top USING (USUBJID)"},
    "VA07": {"rs": "SELECT r.* REPLACE (CASE WHEN s.z > s.a AND r.RSTESTCD = 'OVRLRESP' THEN CASE WHEN r.VISITNUM = s.a THEN 'PR' ELSE 'SD' END ELSE r.RSORRES END AS RSORRES) FROM rs r LEFT JOIN ov s ON s.USUBJID = r.USUBJID"},
    "VA20": {"rs": "SELECT * FROM rs UNION ALL SELECT o9.* REPLACE (top.v AS VISITNUM, 'iCPD' AS RSORRES, top.q AS RSSEQ) FROM o9 JOIN top USING (USUBJID)"},
    "H01": {"rs": _rs("m1", "PD"), "tu": _new_lesion("sdh")},
    "H02": _dm("RFICDTC", _shift("coalesce(x.a, '2014-01-01')", 14)),
    "H03": {"rs": _rs("v0", "CR"), "tr": f"SELECT r.* REPLACE (CASE WHEN m.v IS NOT NULL AND r.TRTESTCD = 'LDIAM' THEN 25.0 ELSE r.TRSTRESN END AS TRSTRESN) FROM tr r LEFT JOIN v0 m {AT}"},
    "H04": {"rs": _rs("v0", "PR"), "tr": _progress("v0") + """ UNION ALL SELECT t9.* REPLACE (v0.v AS VISITNUM, 'TUMSTATE' AS TRTESTCD, 'UNEQUIVOCAL PROGRESSION' AS TRORRES, 'NON-TARGET' AS TRGRPID)
        FROM t9 JOIN v0 USING (USUBJID) WHERE t9.USUBJID NOT IN (FROM has)"""},
    "H05": _dm("ACTARMCD", "CASE WHEN x.USUBJID IS NOT NULL THEN '' ELSE d.ARMCD END AS ARMCD, CASE WHEN x.USUBJID IS NOT NULL THEN '' ELSE d.ACTARMCD END"),
}


def changed_tables(archetypes) -> str:
    """CTEs ``table_ARCHETYPE``, to follow PRELUDE."""
    out = MARKS
    if "H01" in archetypes:  # the new lesion goes to the first SD visit that the changed responses leave
        out += f", rs_H01 AS ({CHANGED['H01']['rs']}), sdh AS (SELECT USUBJID, coalesce(min(VISITNUM) FILTER (WHERE RSORRES = 'SD'), min(VISITNUM)) AS v FROM rs_H01 GROUP BY ALL)\n"
    return out + "".join(f", {t}_{a} AS ({sql})\n" for a in archetypes for t, sql in CHANGED[a].items() if (a, t) != ("H01", "rs"))


def on_changed(check: str, archetype: str) -> str:
    sql = check_sql(check)
    for t in CHANGED[archetype]:
        sql = re.sub(rf"\b{t}\b(?!\.)", f"{t}_{archetype}", sql)
    return sql


def flag_sets(archetypes, checks=LOCAL, own_only: bool = False) -> str:
    """CTEs ``was`` (subject, archetype, n), ``tried`` (injected, subject) and ``now`` (injected, subject, archetype, n)."""
    own = lambda a: (a[-3:],) if own_only else affected(a, checks)
    ran = tuple(dict.fromkeys(c for a in archetypes for c in ((a[-3:],) if own_only else checks) if c in checks))
    was = " UNION ALL ".join(f"SELECT subject, archetype FROM ({check_sql(c)})" for c in ran)
    now = " UNION ALL ".join(f"SELECT '{a}' AS injected, subject, archetype FROM ({on_changed(c, a)})" for a in archetypes for c in own(a))
    names = ", ".join(f"('{a}')" for a in archetypes)
    return stored(PRELUDE + TRV + LOOKUP_SQL + changed_tables(archetypes) + f""", was0 AS (SELECT * FROM ({was})), was AS (SELECT subject, archetype, count(*) AS n FROM was0 GROUP BY ALL),
      tried AS (SELECT injected, USUBJID AS subject FROM (VALUES {names}) k(injected), (SELECT DISTINCT USUBJID FROM dm)
                WHERE (USUBJID, right(injected, 3)) NOT IN (SELECT (subject, archetype) FROM was)),
      now0 AS (SELECT * FROM ({now})), now AS (SELECT injected, subject, archetype, count(*) AS n FROM now0 JOIN tried USING (injected, subject) GROUP BY ALL)
    """)


ARM = """, arm17 AS (SELECT USUBJID FROM dm t WHERE EXISTS (SELECT 1 FROM dm x WHERE x.ARMCD = t.ARMCD AND x.ARM <> t.ARM)),
  free17 AS (SELECT USUBJID, arg_min(ARMCD, STUDYID) AS a FROM dm WHERE ARMCD IS NOT NULL AND USUBJID NOT IN (FROM arm17) GROUP BY ALL),
  low17 AS (SELECT a, min(s) AS p1, min(s) FILTER (WHERE k = 2) AS p2 FROM (SELECT ARMCD AS a, USUBJID AS s, dense_rank() OVER (PARTITION BY ARMCD ORDER BY USUBJID) AS k FROM dm) GROUP BY ALL),
  mine17 AS (SELECT USUBJID, CASE WHEN p1 <> USUBJID THEN p1 ELSE coalesce(p2, USUBJID) END AS p FROM free17 JOIN low17 USING (a)),
  peer17 AS (SELECT DISTINCT p FROM mine17),
  dm17 AS (SELECT p, USUBJID, ARMCD, CASE WHEN USUBJID = p THEN 'CONFLICTING ARM NAME' ELSE ARM END AS ARM FROM dm, peer17),
  after17 AS (SELECT p, USUBJID FROM dm17 t WHERE EXISTS (SELECT 1 FROM dm17 x WHERE x.p = t.p AND x.ARMCD = t.ARMCD AND x.ARM <> t.ARM)),
  eff17 AS (SELECT p, (SELECT count(*) FROM after17 a WHERE a.p = q.p) - (SELECT count(*) FROM arm17) AS d,
    EXISTS (SELECT 1 FROM after17 a WHERE a.p = q.p AND a.USUBJID NOT IN (FROM arm17)) AS hit FROM peer17 q),
  each17 AS (SELECT USUBJID, d, hit FROM mine17 JOIN eff17 USING (p))
"""
LOOKUP = """, bare AS (SELECT * FROM rs WHERE RSTESTCD NOT IN ('NTOVRLRESP', 'NEWLEC')),
  first19 AS (SELECT USUBJID, arg_min(RSORRES, struct_pack(a := VISITNUM, b := RSSEQ)) AS r, min(VISITNUM) AS v FROM bare WHERE RSTESTCD = 'OVRLRESP' GROUP BY ALL),
  tried19 AS (SELECT DISTINCT USUBJID FROM dm WHERE USUBJID NOT IN (SELECT USUBJID FROM first19 WHERE r = 'CR')),
  hit19 AS (SELECT f.USUBJID FROM first19 f JOIN (SELECT USUBJID, min(VISITNUM) AS v FROM bare GROUP BY ALL) b USING (USUBJID) WHERE (f.v = b.v OR f.r = 'CR') AND f.USUBJID IN (FROM tried19))
"""
STATUS = "CASE WHEN candidates_detected > 0 THEN 'detected' WHEN candidates_tried > 0 THEN 'missed' ELSE 'no candidate' END AS status"


def verdict_rows(archetypes) -> str:
    names = ", ".join(f"('{a}')" for a in archetypes)
    return f"""SELECT k.injected AS archetype, count(t.subject) AS candidates_tried, count(h.subject) AS candidates_detected, min(h.subject) AS first_detected
      FROM (VALUES {names}) k(injected) LEFT JOIN tried t ON t.injected = k.injected
      LEFT JOIN (SELECT DISTINCT injected, subject FROM now WHERE archetype = right(injected, 3)) h ON h.injected = t.injected AND h.subject = t.subject GROUP BY k.injected"""


def all_verdicts_sql(last: str) -> str:
    alone = tuple(a for a in LOCAL if a != "A19")
    return flag_sets(alone, own_only=True) + stored(ARM + LOOKUP) + f""", vs AS (SELECT *, {STATUS} FROM ({verdict_rows(alone)}
      UNION ALL SELECT 'A17', count(*), count_if(hit), min(USUBJID) FILTER (WHERE hit) FROM each17
      UNION ALL SELECT 'A19', (SELECT count(*) FROM tried19), count(*), min(USUBJID) FROM hit19)) {last}"""


# What a whole changed table shows of a row: two numbers and two texts.
SHOWN = {
    "RS": ("VISITNUM", "RSSEQ", "RSTESTCD", "RSORRES"), "TR": ("VISITNUM", "TRSTRESN", "TRSPID", "TRORRES"), "TU": ("VISITNUM", None, "TULNKID", "TUCAT"),
    "EX": ("EXSEQ", None, "EXSTDTC", None), "DS": (None, None, "DSDECOD", None), "RELREC": (None, None, "RDOMAIN", "RELID"), "DM": (None, None, "ARMCD", "ACTARMCD"),
}


def every_table(archetype: str, tables: tuple[str, ...]) -> str:
    """All changed tables as one tagged union."""
    def part(d: str) -> str:
        cells = [f"CAST({c or 'NULL'} AS {'DOUBLE' if i < 2 else 'VARCHAR'}) AS {n}" for i, (c, n) in enumerate(zip(SHOWN[d], ("n1", "n2", "t1", "t2")))]
        return f"SELECT '{d}' AS domain, USUBJID, {', '.join(cells)} FROM {d.lower()}_{archetype}"
    return stored(PRELUDE + changed_tables((archetype,))) + " UNION ALL ".join(part(d) for d in tables)
