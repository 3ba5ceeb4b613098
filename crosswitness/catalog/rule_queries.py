"""Leaf predicates, condition trees and the rule table over the derived study."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswitness.catalog.check_queries import ALL, FLAT, LOOKUP_SQL, TRV, check_sql, key_sql
from crosswitness.catalog.testbed import PRELUDE, study
from crosswitness.functions import leaves as lv
from crosswitness.plans.rules import single_table_rules
from crosswitness.plans.validate import validate

NT6 = "('Screen Failure', 'Not Assigned', 'Not Treated', 'SCREEN FAILURE', 'NOT ASSIGNED', 'NOT TREATED')"
NT4 = "('Screen Failure', 'Not Assigned', 'SCREEN FAILURE', 'NOT ASSIGNED')"
ETH = "('HISPANIC OR LATINO', 'NOT HISPANIC OR LATINO')"
DEAD = "DTHFL IS DISTINCT FROM 'Y'"


def _dates(a: str, b: str) -> str:
    return f"{a} IS NULL OR {b} IS NULL OR NOT {a} < {b}"


def _p(*names: str) -> str:
    return " AND ".join(f"{n} IS NOT NULL" for n in names)


def dm_rules(frozen: bool) -> dict[int, str]:
    """Violation predicates; frozen comparators are text constants."""
    other = (lambda n: f"'{n}'") if frozen else (lambda n: n)

    def diff(a: str, b: str) -> str:
        return f"{a} IS DISTINCT FROM {other(b)}"

    return {
        6: f"DTHFL IS NOT NULL AND {DEAD}", 7: f"DTHDTC IS NOT NULL AND {DEAD}", 8: f"SSSTRESC = 'DEAD' AND {DEAD}",
        10: "length(ARMCD) >= 21", 45: "ARMCD IS NULL AND ARMNRS IS NULL", 46: "ARM IS NULL AND ARMNRS IS NULL",
        68: _p("AGETXT"), 69: _p("SPECIES"), 70: _p("STRAIN"), 71: _p("SBSTRAIN"), 73: _p("RPATHCD"), 88: "length(SETCD) >= 9",
        115: "lower(ARM) IN ('screen failure', 'not assigned', 'not treated', 'unplanned treatment')",
        119: "ARMCD IS NULL AND ARM IS NOT NULL", 120: "ACTARMCD IS NULL AND ACTARM IS NOT NULL",
        121: _p("ARMCD", "ACTARMCD", "ARMNRS"), 122: "AGEU IS NOT NULL AND AGE IS NULL AND AGETXT IS NULL",
        174: _p("SPECIES"), 175: _p("STRAIN"), 176: _p("SBSTRAIN"), 185: "length(ACTARMCD) > 20",
        189: "AGE IS NOT NULL AND AGEU IS NULL", 190: "AGEU IS NOT NULL AND AGE IS NULL",
        191: "ARM IS NOT NULL AND RFENDTC IS NULL", 192: _p("ARMNRS", "RFENDTC"),
        223: "ACTARMCD IS NULL AND ARMNRS IS NULL", 224: "ACTARM IS NULL AND ARMNRS IS NULL",
        252: f"DSDECOD = 'DEATH' AND {DEAD}", 253: f"AESDTH = 'Y' AND {DEAD}", 254: f"AEOUT = 'FATAL' AND {DEAD}",
        310: "AGE < 0", 325: "(TXPARMCD = 'ARMCD' AND length(TXVAL) > 20) OR length(ARMCD) > 20",
        330: f"ARM IN {NT4} AND {diff('ARM', 'ACTARM')}", 369: f"ACTARM IN {NT6} AND RFENDTC IS NOT NULL",
        377: f"ARMCD IN ('SCRNFAIL', 'NOTASSGN') AND {diff('ARMCD', 'ACTARMCD')}",
        378: f"ACTARM NOT IN {NT6} AND RFENDTC IS NULL", 379: f"ACTARM IN {NT6} AND RFSTDTC IS NOT NULL",
        380: f"ACTARM NOT IN {NT6} AND RFSTDTC IS NULL",
        452: "AGEU IS NULL AND (AGETXT IS NOT NULL OR AGE IS NOT NULL)", 453: "AGEU IS NOT NULL AND AGETXT IS NULL AND AGE IS NULL",
        493: "NOT regexp_matches(AGETXT, '^[0-9]+-[0-9]+$')", 498: "AGETXT IS NOT NULL AND (BRTHDTC IS NOT NULL OR AGE IS NOT NULL)",
        530: f"ACTARM IN {NT4} AND {diff('ACTARM', 'ARM')}",
        543: f"ACTARMCD IN ('SCRNFAIL', 'NOTASSGN') AND {diff('ACTARMCD', 'ARMCD')}",
        631: _p("RFICDTC"), 632: _p("RFPENDTC"), 633: _p("RACE"), 634: _p("INVNAM"), 635: _p("INVID"), 636: _p("ETHNIC"),
        637: _p("DTHFL"), 638: _p("DTHDTC"), 639: _p("COUNTRY"), 640: _p("ACTARM"), 641: _p("ACTARMCD"),
        645: "AGE IS NULL AND AGETXT IS NULL", 648: "AGE IS NULL AND AGETXT IS NULL",
        655: f"{_p('ARMCD', 'ACTARMCD')} AND {diff('ACTARMCD', 'ARMCD')}", 656: f"{_p('ARM', 'ACTARM')} AND {diff('ACTARM', 'ARM')}",
        658: _dates("RFICDTC", "RFXSTDTC"), 705: "DTHFL = 'Y' AND DTHDTC IS NULL",
        709: f"(CETERM = 'DEATH' OR CEDECOD = 'DEATH') AND {DEAD}", 711: _dates("RFSTDTC", "RFENDTC"),
        713: _dates("RFICDTC", "RFSTDTC"), 714: _dates("RFXSTDTC", "RFXENDTC"),
        721: "lower(ARM) IN ('screen failure', 'not assigned', 'not exposed to product', 'unplanned product exposure')",
        726: f"(QNAM = 'CETHNIC' AND QVAL NOT IN {ETH} AND ETHNIC NOT IN {ETH}) OR ETHNIC NOT IN {ETH}",
        746: "ETHNIC <> 'HISPANIC OR LATINO' AND QNAM = 'CETHNIC' AND QVAL = 'SPANISH ORIGIN'",
        747: "RACE <> 'BLACK OR AFRICAN AMERICAN' AND QNAM = 'CRACE' AND QVAL = 'HATIAN or NEGRO'",
        758: "ARMNRS <> 'UNPLANNED TREATMENT' AND RFSTDTC IS NOT NULL", 760: _dates("RFCSTDTC", "RFCENDTC"),
        883: "AGEU IS NULL AND (AGETXT IS NOT NULL OR AGE IS NOT NULL)",
        903: f"variable_name IS NOT NULL AND {diff('variable_name', 'library_variable_name')}",
        1043: "AGE IS NULL AND (ARMNRS NOT IN ('SCREEN FAILURE', 'Screen Failure') OR ARMCD <> 'SCRNFAIL')",
    }


ABSENT = {
    "dm": "RFENDTC ARMNRS AGETXT SPECIES STRAIN SBSTRAIN RPATHCD SETCD SSSTRESC DSDECOD AESDTH AEOUT TXPARMCD TXVAL RFPENDTC INVNAM "
          "INVID COUNTRY BRTHDTC CETERM CEDECOD QNAM QVAL RFCSTDTC RFCENDTC variable_name library_variable_name",
    "ex": "EXMETHOD EXDOSTXT EXLOT EXSTDY", "rs": "QSEVAL FTEVAL QSEVALID FTEVALID", "tr": "TRLOC TRPORTOT TRDIR TRLAT",
}


def _wide(name: str) -> str:
    return f", {name}w AS (SELECT t.*, " + ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ABSENT[name].split()) + f" FROM {name} t)"


def rules_sql(include_disabled: bool, frozen: bool) -> str:
    quiet = set(range(631, 642))
    rules = [("dm", n, p) for n, p in dm_rules(frozen).items() if include_disabled or n not in quiet]
    rules += [("ex", 5, "EXTRT = 'PLACEBO' AND EXDOSE IS DISTINCT FROM 0"), ("ex", 326, _p("EXMETHOD")),
              ("ex", 385, "TRUE" if frozen else "EXSTDTC IS NULL AND EXSTDY IS NULL"), ("ex", 445, _p("EXDOSTXT", "EXDOSE")),
              ("ex", 599, "EXDOSE = 0 AND EXLOT IS NOT NULL"), ("rs", 31, "QSEVAL IS NOT NULL OR FTEVAL IS NOT NULL"),
              ("rs", 32, "QSEVALID IS NOT NULL OR FTEVALID IS NOT NULL"), ("tr", 3, _p("TRLOC")), ("tr", 76, _p("TRPORTOT")),
              ("tr", 77, _p("TRDIR")), ("tr", 78, _p("TRLAT"))]
    parts = []
    for name, n, predicate in rules:
        d = name.upper()
        visit = "CAST(t.VISITNUM AS VARCHAR)" if name in ("rs", "tr") else "CAST(NULL AS VARCHAR)"
        parts.append(
            f"SELECT t.USUBJID AS subject, {visit} AS visit, 'L1' AS layer, 'CORE-{n:06d}' AS archetype, 'CORE-{n:06d}' AS rule_id, "
            f"'{d}' AS domain, concat('{d}/', t.USUBJID, '/', {key_sql(d)}) AS record_id, 'violation' AS severity "
            f"FROM {name}w t WHERE {predicate}")
    return PRELUDE + "".join(_wide(n) for n in ABSENT) + " UNION ALL ".join(parts)


# Every leaf is shown as a flag column over whole tables, NULL and '' included.
LEAF_CASES = {
    "OP01": ("DM", lambda c: lv.non_empty(c("DTHFL")), "DTHFL IS NOT NULL"),
    "OP02": ("DM", lambda c: lv.LEAVES["exists"](c("RFICDTC")), "RFICDTC IS NOT NULL"),
    "OP03": ("DM", lambda c: lv.empty(c("AGEU")), "AGEU IS NULL"),
    "OP04": ("DM", lambda c: lv.LEAVES["not_exists"](c("ACTARM")), "ACTARM IS NULL"),
    "OP05": ("DM", lambda c: lv.equal_to(c("DTHFL"), "Y"), "DTHFL IS NOT DISTINCT FROM 'Y'"),
    "OP06": ("DM", lambda c: lv.not_equal_to(c("DTHFL"), "Y"), "DTHFL IS DISTINCT FROM 'Y'"),
    "OP07": ("DM", lambda c: lv.is_contained_by(c("ACTARMCD"), ["AUT", "BUI"]), "coalesce(ACTARMCD IN ('AUT', 'BUI'), FALSE)"),
    "OP08": ("DM", lambda c: lv.is_not_contained_by(c("ACTARMCD"), ["AUT", "BUI"]), "ACTARMCD IS NOT NULL AND ACTARMCD NOT IN ('AUT', 'BUI')"),
    "OP09": ("DM", lambda c: lv.is_contained_by_ci(c("ACTARM"), ["not treated", "building"]),
             "coalesce(lower(ACTARM) IN ('not treated', 'building'), FALSE)"),
    "OP10": ("DM", lambda c: lv.is_not_contained_by_ci(c("ACTARM"), ["not treated", "building"]),
             "ACTARM IS NOT NULL AND lower(ACTARM) NOT IN ('not treated', 'building')"),
    "OP11": ("DM", lambda c: lv.longer_than(c("ACTARM"), 9), "coalesce(length(ACTARM) > 9, FALSE)"),
    "OP12": ("DM", lambda c: lv.less_than(c("AGE"), 18), "coalesce(AGE < 18, FALSE)"),
    "OP13": ("DM", lambda c: lv.matches_regex(c("ACTARM"), "^[A-M].*E"), "coalesce(regexp_matches(ACTARM, '^[A-M].*E'), FALSE)"),
    "OP14": ("DM", lambda c: lv.not_matches_regex(c("ACTARM"), "^[A-M].*E"), "ACTARM IS NOT NULL AND NOT regexp_matches(ACTARM, '^[A-M].*E')"),
    "OP15": ("DM", lambda c: lv.date_greater_than(c("RFICDTC"), c("RFSTDTC")),
             "RFICDTC IS NOT NULL AND RFSTDTC IS NOT NULL AND NOT (RFICDTC < RFSTDTC)"),
}
TREES = {
    "OP16": ({"all": [{"op": "non_empty", "col": "DTHFL"}, {"op": "empty", "col": "DTHDTC"}]}, "DTHFL IS NOT NULL AND DTHDTC IS NULL"),
    "OP17": ({"any": [{"op": "equal_to", "col": "SEX", "value": "M"}, {"op": "less_than", "col": "AGE", "value": 10}]},
             "coalesce(SEX = 'M', FALSE) OR coalesce(AGE < 10, FALSE)"),
    "OP18": ({"not": {"any": [{"op": "equal_to", "col": "SEX", "value": "M"}, {"op": "not_equal_to", "col": "DTHFL", "value": "Y"}]}},
             "NOT (SEX IS NOT DISTINCT FROM 'M' OR DTHFL IS DISTINCT FROM 'Y')"),
}


def queries() -> dict:
    def leaf(domain, build):
        return lambda spark, sf: study(spark, sf)[domain].select("STUDYID", "USUBJID", build(F.col).alias("holds"))

    def tree(t):
        def run(spark, sf):
            dm = study(spark, sf)["DM"]
            return dm.select("STUDYID", "USUBJID", lv.compile_tree(t, dm).alias("holds"))
        return run

    out = {name: leaf(domain, build) for name, (domain, build, _) in LEAF_CASES.items()}
    out.update({name: tree(t) for name, (t, _) in TREES.items()})
    out["RULES"] = lambda spark, sf: single_table_rules(study(spark, sf)).select(*FLAT)
    out["VALIDATE"] = lambda spark, sf: validate(study(spark, sf)).flags.select(*FLAT)
    out["VALIDATE-COUNTS"] = lambda spark, sf: validate(study(spark, sf)).counts
    out["RULES-COMPAT"] = lambda spark, sf: single_table_rules(study(spark, sf), include_disabled=True, literal_compat=True).select(*FLAT)
    return out


def oracle() -> dict:
    out = {name: PRELUDE + f"SELECT STUDYID, USUBJID, ({sql}) AS holds FROM {domain.lower()}" for name, (domain, _, sql) in LEAF_CASES.items()}
    out.update({name: PRELUDE + f"SELECT STUDYID, USUBJID, ({sql}) AS holds FROM dm" for name, (_, sql) in TREES.items()})
    out["RULES"] = rules_sql(False, False)
    out["RULES-COMPAT"] = rules_sql(True, True)
    checks = PRELUDE + TRV + LOOKUP_SQL + " UNION ALL ".join(check_sql(i) for i in ALL)
    out["VALIDATE"] = f"SELECT DISTINCT * FROM (SELECT * FROM ({out['RULES']}) UNION ALL SELECT * FROM ({checks}))"
    out["VALIDATE-COUNTS"] = f"""SELECT CASE WHEN regexp_matches(rule_id, '^S[0-9]') THEN 'derivation' WHEN regexp_matches(rule_id, '^A[0-9][0-9]$') THEN 'archetype'
      ELSE 'structural' END AS family, count(*) AS flags, count(DISTINCT subject) AS subjects FROM ({out['VALIDATE']}) GROUP BY 1"""
    return out
