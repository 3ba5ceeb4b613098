"""Single-table rules as data, evaluated in one pass per table.

A rule is a condition tree describing the *violation*.  ``other`` leaves compare with
another column; those marked frozen can be evaluated with the column name as a text
constant (``literal_compat``) to match results produced that way.  Rules that fire on
every populated row are kept but disabled by default.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswitness.functions.columns import with_record_id
from crosswitness.functions.leaves import compile_tree
from crosswitness.sources.study import Study

RULES_PER_MASK = 60


@dataclass(frozen=True)
class Rule:
    id: str
    domain: str
    tree: dict
    enabled: bool = True
    severity: str = "violation"


def P(col: str) -> dict:
    return {"op": "non_empty", "col": col}


def N(col: str) -> dict:
    return {"op": "empty", "col": col}


def eq(col: str, value) -> dict:
    return {"op": "equal_to", "col": col, "value": value}


def ne(col: str, value) -> dict:
    return {"op": "not_equal_to", "col": col, "value": value}


def isin(col: str, *values: str) -> dict:
    return {"op": "is_contained_by", "col": col, "value": values}


def notin(col: str, *values: str) -> dict:
    return {"op": "is_not_contained_by", "col": col, "value": values}


def anycase(col: str, *values: str) -> dict:
    return {"op": "is_contained_by_case_insensitive", "col": col, "value": values}


def longer(col: str, n: int) -> dict:
    return {"op": "longer_than", "col": col, "value": n}


def rx(col: str, pattern: str) -> dict:
    return {"op": "matches_regex", "col": col, "value": pattern}


def not_rx(col: str, pattern: str) -> dict:
    return {"op": "not_matches_regex", "col": col, "value": pattern}


def differs(col: str, other: str) -> dict:
    return {"op": "not_equal_to", "col": col, "other": other, "frozen": True}


def All(*parts: dict) -> dict:
    return {"all": list(parts)}


def Any(*parts: dict) -> dict:
    return {"any": list(parts)}


def ordered(first: str, second: str) -> dict:
    """Violated unless both dates exist and the first is before the second."""
    return Any(N(first), N(second), {"op": "date_greater_than", "col": first, "other": second})


# Code lists and rule conditions.
NOT_TREATED = ("Screen Failure", "Not Assigned", "Not Treated", "SCREEN FAILURE", "NOT ASSIGNED", "NOT TREATED")
NOT_ASSIGNED = ("Screen Failure", "Not Assigned", "SCREEN FAILURE", "NOT ASSIGNED")
ETHNICITIES = ("HISPANIC OR LATINO", "NOT HISPANIC OR LATINO")


def _dm(number: int, tree: dict, enabled: bool = True) -> Rule:
    return Rule(f"CORE-{number:06d}", "DM", tree, enabled)


RULES: tuple[Rule, ...] = (
    _dm(6, All(P("DTHFL"), ne("DTHFL", "Y"))),
    _dm(7, All(P("DTHDTC"), ne("DTHFL", "Y"))),
    _dm(8, All(eq("SSSTRESC", "DEAD"), ne("DTHFL", "Y"))),
    _dm(10, rx("ARMCD", "^(.){21,}$")),
    _dm(45, All(N("ARMCD"), N("ARMNRS"))),
    _dm(46, All(N("ARM"), N("ARMNRS"))),
    _dm(68, P("AGETXT")),
    _dm(69, P("SPECIES")),
    _dm(70, P("STRAIN")),
    _dm(71, P("SBSTRAIN")),
    _dm(73, P("RPATHCD")),
    _dm(88, rx("SETCD", "^(.){9,}$")),
    _dm(115, anycase("ARM", "Screen Failure", "Not Assigned", "Not Treated", "Unplanned Treatment")),
    _dm(119, All(N("ARMCD"), P("ARM"))),
    _dm(120, All(N("ACTARMCD"), P("ACTARM"))),
    _dm(121, All(P("ARMCD"), P("ACTARMCD"), P("ARMNRS"))),
    _dm(122, All(P("AGEU"), N("AGE"), N("AGETXT"))),
    _dm(174, P("SPECIES")),
    _dm(175, P("STRAIN")),
    _dm(176, P("SBSTRAIN")),
    _dm(185, longer("ACTARMCD", 20)),
    _dm(189, All(P("AGE"), N("AGEU"))),
    _dm(190, All(P("AGEU"), N("AGE"))),
    _dm(191, All(P("ARM"), N("RFENDTC"))),
    _dm(192, All(P("ARMNRS"), P("RFENDTC"))),
    _dm(223, All(N("ACTARMCD"), N("ARMNRS"))),
    _dm(224, All(N("ACTARM"), N("ARMNRS"))),
    _dm(252, All(eq("DSDECOD", "DEATH"), ne("DTHFL", "Y"))),
    _dm(253, All(eq("AESDTH", "Y"), ne("DTHFL", "Y"))),
    _dm(254, All(eq("AEOUT", "FATAL"), ne("DTHFL", "Y"))),
    _dm(310, {"op": "less_than", "col": "AGE", "value": 0}),
    _dm(325, Any(All(eq("TXPARMCD", "ARMCD"), longer("TXVAL", 20)), longer("ARMCD", 20))),
    _dm(330, All(isin("ARM", *NOT_ASSIGNED), differs("ARM", "ACTARM"))),
    _dm(369, All(isin("ACTARM", *NOT_TREATED), P("RFENDTC"))),
    _dm(377, All(isin("ARMCD", "SCRNFAIL", "NOTASSGN"), differs("ARMCD", "ACTARMCD"))),
    _dm(378, All(P("ACTARM"), notin("ACTARM", *NOT_TREATED), N("RFENDTC"))),
    _dm(379, All(isin("ACTARM", *NOT_TREATED), P("RFSTDTC"))),
    _dm(380, All(P("ACTARM"), notin("ACTARM", *NOT_TREATED), N("RFSTDTC"))),
    _dm(452, All(N("AGEU"), Any(P("AGETXT"), P("AGE")))),
    _dm(453, All(P("AGEU"), N("AGETXT"), N("AGE"))),
    _dm(493, not_rx("AGETXT", "^[0-9]+-[0-9]+$")),
    _dm(498, All(P("AGETXT"), Any(P("BRTHDTC"), P("AGE")))),
    _dm(530, All(isin("ACTARM", *NOT_ASSIGNED), differs("ACTARM", "ARM"))),
    _dm(543, All(isin("ACTARMCD", "SCRNFAIL", "NOTASSGN"), differs("ACTARMCD", "ARMCD"))),
    _dm(631, P("RFICDTC"), False),
    _dm(632, P("RFPENDTC"), False),
    _dm(633, P("RACE"), False),
    _dm(634, P("INVNAM"), False),
    _dm(635, P("INVID"), False),
    _dm(636, P("ETHNIC"), False),
    _dm(637, P("DTHFL"), False),
    _dm(638, P("DTHDTC"), False),
    _dm(639, P("COUNTRY"), False),
    _dm(640, P("ACTARM"), False),
    _dm(641, P("ACTARMCD"), False),
    _dm(645, All(N("AGE"), N("AGETXT"))),
    _dm(648, All(N("AGE"), N("AGETXT"))),
    _dm(655, All(P("ARMCD"), P("ACTARMCD"), differs("ACTARMCD", "ARMCD"))),
    _dm(656, All(P("ARM"), P("ACTARM"), differs("ACTARM", "ARM"))),
    _dm(658, ordered("RFICDTC", "RFXSTDTC")),
    _dm(705, All(eq("DTHFL", "Y"), N("DTHDTC"))),
    _dm(709, All(Any(eq("CETERM", "DEATH"), eq("CEDECOD", "DEATH")), ne("DTHFL", "Y"))),
    _dm(711, ordered("RFSTDTC", "RFENDTC")),
    _dm(713, ordered("RFICDTC", "RFSTDTC")),
    _dm(714, ordered("RFXSTDTC", "RFXENDTC")),
    _dm(721, anycase("ARM", "Screen Failure", "Not Assigned", "Not Exposed to Product", "Unplanned Product Exposure")),
    _dm(726, Any(All(eq("QNAM", "CETHNIC"), notin("QVAL", *ETHNICITIES), notin("ETHNIC", *ETHNICITIES)),
                 notin("ETHNIC", *ETHNICITIES))),
    _dm(746, All(P("ETHNIC"), ne("ETHNIC", "HISPANIC OR LATINO"), eq("QNAM", "CETHNIC"), eq("QVAL", "SPANISH ORIGIN"))),
    _dm(747, All(P("RACE"), ne("RACE", "BLACK OR AFRICAN AMERICAN"), eq("QNAM", "CRACE"), eq("QVAL", "HATIAN or NEGRO"))),
    _dm(758, All(P("ARMNRS"), ne("ARMNRS", "UNPLANNED TREATMENT"), P("RFSTDTC"))),
    _dm(760, ordered("RFCSTDTC", "RFCENDTC")),
    _dm(883, All(N("AGEU"), Any(P("AGETXT"), P("AGE")))),
    _dm(903, All(P("variable_name"), differs("variable_name", "library_variable_name"))),
    _dm(1043, All(N("AGE"), Any(All(P("ARMNRS"), notin("ARMNRS", "SCREEN FAILURE", "Screen Failure")),
                                All(P("ARMCD"), ne("ARMCD", "SCRNFAIL"))))),
    Rule("CORE-000005", "EX", All(eq("EXTRT", "PLACEBO"), ne("EXDOSE", 0))),
    Rule("CORE-000326", "EX", P("EXMETHOD")),
    Rule("CORE-000385", "EX", All(N("--STDTC"), N("--STDY"))),
    Rule("CORE-000445", "EX", All(P("EXDOSTXT"), P("EXDOSE"))),
    Rule("CORE-000599", "EX", All(eq("EXDOSE", 0), P("EXLOT"))),
    Rule("CORE-000031", "RS", Any(P("QSEVAL"), P("FTEVAL"))),
    Rule("CORE-000032", "RS", Any(P("QSEVALID"), P("FTEVALID"))),
    Rule("CORE-000003", "TR", P("TRLOC")),
    Rule("CORE-000076", "TR", P("TRPORTOT")),
    Rule("CORE-000077", "TR", P("TRDIR")),
    Rule("CORE-000078", "TR", P("TRLAT")),
)


def expand_prefix(tree: dict, domain: str) -> dict:
    """Replace the ``--`` column prefix by the domain code."""
    for word in ("all", "any"):
        if word in tree:
            return {word: [expand_prefix(t, domain) for t in tree[word]]}
    if "not" in tree:
        return {"not": expand_prefix(tree["not"], domain)}
    return {k: (v.replace("--", domain) if k in ("col", "other") else v) for k, v in tree.items()}


def _domain_flags(study: Study, domain: str, rules: list[Rule], literal_compat: bool) -> DataFrame:
    raw = study.raw(domain)
    df = raw if raw is not None else study[domain]
    df = with_record_id(df, domain, df.columns)
    trees = [r.tree if literal_compat else expand_prefix(r.tree, domain) for r in rules]
    masks: list[Column] = []
    for start in range(0, len(rules), RULES_PER_MASK):
        chunk = trees[start:start + RULES_PER_MASK]
        bits = [F.when(compile_tree(t, df, literal_compat), F.lit(1 << n)).otherwise(F.lit(0)).cast("bigint") for n, t in enumerate(chunk)]
        masks.append(reduce(lambda a, b: a + b, bits))
    names = [f"_hits{i}" for i in range(len(masks))]
    who = F.col("USUBJID") if "USUBJID" in df.columns else F.lit("_trial_")
    visit = F.col("VISITNUM").cast("string") if "VISITNUM" in df.columns else F.lit(None).cast("string")
    scope = [k for k in study.scope if k in df.columns]
    df = df.select(*scope, who.alias("subject"), visit.alias("visit"), "record_id", *[m.alias(n) for m, n in zip(masks, names)])
    df = df.filter(reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names]))
    hits = [
        F.when(F.col(names[n // RULES_PER_MASK]).bitwiseAND(F.lit(1 << (n % RULES_PER_MASK)).cast("bigint")) != 0,
               F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity")))
        for n, r in enumerate(rules)
    ]
    df = df.withColumn("_rule", F.explode(F.array(*hits))).filter(F.col("_rule").isNotNull())
    return df.select(
        *scope, "subject", "visit", F.lit("L1").alias("layer"), F.col("_rule.rule_id").alias("archetype"), "_rule.rule_id",
        F.lit(domain).alias("domain"), "record_id", "_rule.severity",
        F.concat(F.lit("Record violates "), F.col("_rule.rule_id")).alias("message"),
        F.array().cast("array<struct<type:string,value:string>>").alias("evidence"),
        F.array("_rule.rule_id").alias("core_rule_xref"), F.lit("RULES").alias("source"))


def single_table_rules(study: Study, rules: tuple[Rule, ...] | None = None, include_disabled: bool = False,
                       literal_compat: bool = False) -> DataFrame:
    """Flags of the rule table; every domain is scanned once for all of its rules."""
    chosen = [r for r in (rules or RULES) if r.enabled or include_disabled]
    out = None
    for domain in dict.fromkeys(r.domain for r in chosen):
        part = _domain_flags(study, domain, [r for r in chosen if r.domain == domain], literal_compat)
        out = part if out is None else out.unionByName(part)
    return out
