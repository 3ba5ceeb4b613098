"""Cross-table checks: A01-A20, S1-S8 and the H probes.

A check names the table whose rows it flags (its focus), a condition on the row alone,
the facts it looks up, and a condition on row plus facts.  Checks with the same focus and
the same lookup keys are evaluated together: the table is read once, filtered to rows any
of them could flag, shuffled once for all their facts, and every condition is evaluated in
a single projection.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswitness.functions.columns import with_record_id
from crosswitness.functions.leaves import any_of
from crosswitness.functions.scalars import MICRO, full_date, micro
from crosswitness.operators.skew import keyed_join, pair_join
from crosswitness.plans import facts as fx
from crosswitness.sources.staging import all_by_subject, written, written_by_subject
from crosswitness.sources.study import Study

FLAG_COLUMNS = (
    "subject", "visit", "layer", "archetype", "rule_id", "domain", "record_id", "severity", "message",
    "evidence", "core_rule_xref", "source",
)
FLAG_SCHEMA = (
    "subject string, visit string, layer string, archetype string, rule_id string, domain string, "
    "record_id string, severity string, message string, evidence array<struct<type:string,value:string>>, "
    "core_rule_xref array<string>, source string"
)


@dataclass(frozen=True)
class Check:
    id: str
    focus: str
    message: str
    local: Callable[[], Column]
    cross: Callable[[], Column] = lambda: F.lit(True)
    facts: tuple[str, ...] = ()
    severity: str = "violation"
    layer: str = "L1"
    evidence: tuple[str, ...] = field(default=())


def c(name: str) -> Column:
    return F.col(name)


def _absent(name: str) -> Column:
    return F.col(name).isNull()


def _filled(name: str) -> Column:
    return c(name).isNotNull() & (c(name) != "")


def _assigned() -> Column:
    return c("ACTARMCD").isNotNull() & ~c("ACTARMCD").isin("", "Scrnfail")


def _post_baseline() -> Column:
    return c("VISITNUM") > c("_bl")


def _small_growth() -> Column:
    return ~_large_growth()


def _large_growth() -> Column:
    """By a fifth and by 5 mm over the nadir."""
    now, low = micro(c("_sld")), micro(c("_nadir"))
    return (now * 100 >= low * 120) & (now - low >= 5 * MICRO)


def _shrunk() -> Column:
    """To 70% of the baseline or less."""
    return micro(c("_sld")) * 100 <= micro(c("_base")) * 70


CHECKS: dict[str, Check] = {}


def register_check(check: Check) -> Check:
    """Add a check to the registry used by :func:`run_checks`."""
    CHECKS[check.id] = check
    return check


for _check in (
    # -- responses ---------------------------------------------------------------
    Check("A01", "RS", "Overall response PD although a lesion shrank by 30% or more since its previous visit",
          lambda: fx.is_overall() & (c("RSORRES") == "PD"), lambda: c("_shrunk").isNotNull(), ("shrunk_visit",),
          evidence=("RSORRES",)),
    Check("A04", "RS", "Response recorded at a fractional visit number",
          lambda: c("VISITNUM") != F.floor("VISITNUM"), evidence=("VISITNUM",)),
    Check("A07", "RS", "PR is not followed by a confirming PR or CR",
          lambda: fx.is_overall() & (c("RSORRES") == "PR") & c("RSDTC").isNotNull(),
          lambda: (c("VISITNUM") < c("_last_visit")) & ~F.coalesce(c("_last_conf") > c("VISITNUM"), F.lit(False)),
          ("rs_subject",), severity="warning", evidence=("RSORRES", "RSDTC")),
    Check("A20", "RS", "iCPD is not followed by a confirming iCPD",
          lambda: fx.is_overall() & (c("RSORRES") == "iCPD") & c("VISITNUM").isNotNull(),
          lambda: ~F.coalesce(c("_last_icpd") > c("VISITNUM"), F.lit(False)), ("rs_subject",),
          evidence=("RSORRES",)),
    Check("H03", "RS", "Overall response CR while a target lesion is measurable",
          lambda: fx.is_overall() & (c("RSORRES") == "CR"), lambda: c("_measurable").isNotNull(),
          ("measurable_visit",), evidence=("RSORRES",)),
    # -- derivations ----------------------------------------------------------------
    Check("S1", "RS", "Reported sum of diameters differs from the sum of target measurements",
          lambda: (c("RSCAT") == "TARGET RESPONSE") & (c("RSTESTCD") == "SUMDIAM"),
          lambda: micro(c("_sld")) != micro(c("RSSTRESN")), ("tr_visit",), evidence=("RSSTRESN", "_sld")),
    Check("S2", "RS", "All target diameters are zero and no node is enlarged but the response is not CR",
          lambda: fx.is_target_response() & (c("RSORRES") != "CR"),
          lambda: (c("_measured") > 0) & (c("_positive") == 0) & (c("_nodes") == 0), ("tr_visit",),
          evidence=("RSORRES",)),
    Check("S3", "RS", "Sum of diameters fell by 30% or more but the response is neither PR nor CR",
          lambda: fx.is_target_response() & ~c("RSORRES").isin("PR", "CR"),
          lambda: _post_baseline() & _shrunk(), ("tr_visit",),
          evidence=("RSORRES", "_sld", "_base")),
    Check("S4", "RS", "Sum of diameters grew by 20% and 5 mm over its nadir but the response is not PD",
          lambda: fx.is_target_response() & (c("RSORRES") != "PD"),
          lambda: _post_baseline() & _large_growth(),
          ("tr_visit",), evidence=("RSORRES", "_sld", "_nadir")),
    Check("S5", "RS", "Neither shrinkage nor growth nor a new lesion but the response is not SD",
          lambda: fx.is_target_response() & (c("RSORRES") != "SD"),
          lambda: _post_baseline() & ~_shrunk() & _small_growth() & _absent("_new_target"),
          ("tr_visit", "new_target_visit"), evidence=("RSORRES", "_sld", "_base", "_nadir")),
    Check("S6", "RS", "A new target lesion appeared after baseline but the response is not PD",
          lambda: fx.is_target_response() & (c("RSORRES") != "PD"), lambda: c("_new_target").isNotNull(),
          ("new_target_visit",), evidence=("RSORRES",)),
    Check("S7", "RS", "CR or PR is not confirmed by a CR or PR at least 28 days later",
          lambda: fx.is_target_response() & c("RSORRES").isin("CR", "PR") & c("RSDTC").isNotNull(),
          lambda: ~F.coalesce(F.datediff(c("_last_best_date"), full_date(c("RSDTC"))) >= 28, F.lit(False)),
          ("rs_subject",), severity="warning", evidence=("RSORRES", "RSDTC")),
    Check("S8", "RS", "No target measurement at a visit after baseline but the response is not NE",
          lambda: fx.is_target_response() & (c("RSORRES") != "NE"),
          lambda: (c("VISITNUM") > c("_baseline")) & (F.coalesce(c("_readable"), F.lit(0)) == 0),
          ("tr_visit", "tr_subject"), evidence=("RSORRES",)),
    # -- lesions -------------------------------------------------------------------------
    Check("A02", "TU", "Lesion first seen at a visit whose overall response is not PD",
          lambda: c("TULNKID").isNotNull() & c("VISITNUM").isNotNull(),
          lambda: (c("VISITNUM") <= c("_first_visit")) & c("_has_non_pd"), ("tu_lesion", "ovr_visit"),
          evidence=("TULNKID",)),
    Check("A06", "TR", "Unequivocal progression of a non-target lesion but the overall response is SD",
          fx.is_progression_text, lambda: c("_has_sd"), ("ovr_visit",), evidence=("TRORRES",)),
    Check("A18", "TR", "Unequivocal progression of a non-target lesion but the overall response is not PD",
          fx.is_progression_text, lambda: c("_has_non_pd"), ("ovr_visit",), evidence=("TRORRES",)),
    # -- exposure ---------------------------------------------------------------------
    Check("A03", "EX", "First exposure starts more than 7 days after an attributed adverse event",
          lambda: F.length("EXSTDTC") >= 10,
          lambda: (c("EXSTDTC") == c("_first_start")) & (F.datediff(full_date(c("EXSTDTC")), c("_first_related")) > 7),
          ("ex_subject", "ae_subject"), evidence=("EXSTDTC", "_first_related")),
    # -- subjects -----------------------------------------------------------------------
    Check("A05", "SUPPDM", "Supplemental sex differs from the demographics record",
          lambda: (c("QNAM") == "SEX") & c("QVAL").isNotNull(),
          lambda: (c("_sex_min") != c("QVAL")) | (c("_sex_max") != c("QVAL")), ("dm_subject",), evidence=("QVAL",)),
    Check("A08", "DM", "Arm code is not among the trial arms",
          lambda: c("ARMCD").isNotNull() & ~c("ARMCD").isin("", "Scrnfail"), lambda: _absent("_known_arm"),
          ("ta_arm",), evidence=("ARMCD",)),
    Check("A09", "DM", "Assigned subject has no disposition record", _assigned, lambda: _absent("_disposed"),
          ("ds_subject",), evidence=("ACTARMCD",)),
    Check("A10", "DM", "First-exposure reference date matches no exposure start", lambda: _filled("RFXSTDTC"),
          lambda: _absent("_rfxstdtc_seen"), ("ex_rfxstdtc",), evidence=("RFXSTDTC",)),
    Check("A11", "DM", "Last-exposure reference date matches no exposure end", lambda: _filled("RFXENDTC"),
          lambda: _absent("_rfxendtc_seen"), ("ex_rfxendtc",), evidence=("RFXENDTC",)),
    Check("A12", "DM", "Death flag without a death disposition", lambda: c("DTHFL") == "Y",
          lambda: ~F.coalesce(c("_death"), F.lit(False)), ("ds_subject",), evidence=("DTHFL",)),
    Check("A13", "DM", "Multiple race without supplemental race records", lambda: c("RACE") == "MULTIPLE",
          lambda: _absent("_race_detail"), ("supp_subject",), evidence=("RACE",)),
    Check("A14", "DM", "Assigned subject has no exposure record", _assigned, lambda: _absent("_exposed"),
          ("ex_subject",), evidence=("ACTARMCD",)),
    Check("A15", "DM", "Reference start date matches no exposure start", lambda: _filled("RFSTDTC"),
          lambda: _absent("_rfstdtc_seen"), ("ex_rfstdtc",), evidence=("RFSTDTC",)),
    Check("A16", "DM", "Subject identifier is used by more than one demographics record",
          lambda: F.lit(True), lambda: c("_dm_rows") > 1, ("dm_subject",), evidence=("STUDYID",)),
    Check("A17", "DM", "Arm code maps to several arm names", lambda: c("ARM").isNotNull() & c("ARMCD").isNotNull(),
          lambda: c("_arm_min") != c("_arm_max"), ("dm_arm",), evidence=("ARMCD", "ARM")),
    Check("H02", "DM", "Consent is dated after first exposure", lambda: _filled("RFICDTC"),
          lambda: c("RFICDTC") > c("_any_start"), ("ex_subject",), evidence=("RFICDTC", "_any_start")),
    Check("H05", "DM", "Exposed subject has no arm",
          lambda: (F.coalesce(c("ARMCD"), F.lit("")) == "") & (F.coalesce(c("ACTARMCD"), F.lit("")) == ""),
          lambda: c("_exposed").isNotNull(), ("ex_subject",), evidence=("ARMCD",)),
):
    register_check(_check)

ARCHETYPES = tuple(f"A{i:02d}" for i in range(1, 21))
DERIVATIONS = tuple(f"S{i}" for i in range(1, 9))
PROBES = ("H02", "H03", "H05")


def _evidence_of(df: DataFrame, checks: list[Check]) -> Column:
    """Evidence cells of the check at hand, chosen from the cells any check of the group shows."""
    names = list(dict.fromkeys(n for k in checks for n in k.evidence))
    if not names:
        return F.array().cast("array<struct<type:string,value:string>>")
    label = {n: n.strip("_").upper() for n in names}
    cells = F.array(*[F.struct(F.lit(label[n]).alias("type"), F.col(n).cast("string").alias("value")) for n in names])
    if len(checks) == 1:
        return cells
    shown = F.element_at(F.array(*[F.array(*[F.lit(label[n]) for n in k.evidence]) for k in checks]), F.col("_check") + 1)
    return F.filter(cells, lambda cell: F.array_contains(shown, cell["type"]))


def _group_flags(study: Study, focus: str, checks: list[Check]) -> DataFrame:
    raw = study.raw(focus)
    df = study.seen_from(focus)[focus]
    df = with_record_id(df, focus, raw.columns if raw is not None else df.columns)
    df = df.filter(any_of([k.local() for k in checks]))
    if focus in study.shared:  # only rows that a check could flag meet the scenarios of their subject
        loads = study.load(focus), study.load("scenarios")
        df = pair_join(df, study.scenarios.select("scenario_id", "USUBJID"), ["USUBJID"], loads=loads if all(loads) else None)
    for name in dict.fromkeys(f for k in checks for f in k.facts):
        table = fx.fact(study.seen_from(*fx.FACT_TABLES[name]), name)
        load = study.load(f"{focus} by ARMCD") if fx.FACTS[name][0] == ("ARMCD",) else study.load(focus)
        df = keyed_join(df, table, fx.fact_keys(study, name, table), "left", load)
    if len(checks) == 1:
        df = df.filter(checks[0].cross()).withColumn("_check", F.lit(0))
    else:
        # One bit per check keeps the evaluation of all rows to plain arithmetic; only
        # flagged rows are expanded.
        bits = [F.when(k.local() & k.cross(), F.lit(1 << n)).otherwise(F.lit(0)) for n, k in enumerate(checks)]
        df = df.withColumn("_hits", reduce(lambda x, y: x + y, bits)).filter("_hits > 0")
        which = [F.when(F.col("_hits").bitwiseAND(F.lit(1 << n)) != 0, F.lit(n)) for n in range(len(checks))]
        df = df.withColumn("_check", F.explode(F.array(*which))).filter(c("_check").isNotNull())
    meta = F.array(*[F.struct(
        F.lit(k.layer).alias("layer"), F.lit(k.id if k.id[0] in "AH" else f"DERIVATION-{k.id}").alias("archetype"),
        F.lit(k.id).alias("rule_id"), F.lit(k.severity).alias("severity"), F.lit(k.message).alias("message")) for k in checks])
    visit = c("VISITNUM").cast("string") if "VISITNUM" in df.columns else F.lit(None).cast("string")
    df = df.withColumn("_flag", F.element_at(meta, F.col("_check") + 1))
    return df.select(
        *study.scope, c("USUBJID").alias("subject"), visit.alias("visit"), "_flag.layer", "_flag.archetype",
        "_flag.rule_id", F.lit(focus).alias("domain"), "record_id", "_flag.severity", "_flag.message",
        _evidence_of(df, checks).alias("evidence"), F.array(c("_flag.rule_id")).alias("core_rule_xref"),
        F.lit("RULES").alias("source"),
    )


def check_groups(ids: Iterable[str]) -> list[list[str]]:
    """Checks that share a focus table and lookup keys, and so one pass; A19 stands alone."""
    groups: dict[tuple, list[str]] = {}
    for i in ids:
        key = ("A19",) if i == "A19" else (CHECKS[i].focus, frozenset(fx.FACTS[f][0] for f in CHECKS[i].facts))
        groups.setdefault(key, []).append(i)
    return list(groups.values())


def reads(check_id: str) -> set[str]:
    """Tables that a check depends on."""
    if check_id == "A19":
        return {"RS"}
    return {CHECKS[check_id].focus, *(t for f in CHECKS[check_id].facts for t in fx.FACT_TABLES[f])}


def _measurements_first(study: Study, ids: tuple[str, ...]) -> None:
    """A study on demand can take from its measurements what it would otherwise sum up again, so they are made first."""
    if any("TR" in reads(i) for i in ids):
        study.raw("TR")


def run_checks(study: Study, ids: Iterable[str] = (*ARCHETYPES, *DERIVATIONS), lookup_grain: str = "record") -> DataFrame:
    """Flags of the selected checks, one row per (check, flagged record).

    A study that was never measured is measured first, so that hot subjects are always split.
    """
    from crosswitness.plans.lookup import lookup_flags

    ids = tuple(ids)
    _measurements_first(study, ids)
    study = study if study.loads else study.measured()
    parts = [
        lookup_flags(study, lookup_grain) if group == ["A19"] else _group_flags(study, CHECKS[group[0]].focus, [CHECKS[i] for i in group])
        for group in check_groups(ids)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def flag_counts(study: Study, ids: Iterable[str], path: str | None, only: DataFrame | None = None, concurrent: int = 3,
                injected: str | None = None) -> DataFrame:
    """(subject, archetype, flags) of the selected checks, of the subjects in ``only`` (subject) if given, and what was ``injected`` if named.

    With a path each group of checks is counted in a job of its own.  Where tables lie by subject, the
    groups of one job would be run by the same tasks, each of which then held the sorts of all of them.
    """
    ids = tuple(ids)
    _measurements_first(study, ids)
    study = study if study.loads else study.measured()

    def counted(group: list[str]) -> DataFrame:
        flags = run_checks(study, group)
        flags = flags if only is None else flags.join(only, "subject", "left_semi")
        counts = flags.groupBy("subject", "archetype").agg(F.count(F.lit(1)).alias("flags"))
        return written(counts if injected is None else counts.withColumn("injected", F.lit(injected)), path and f"{path}/{'-'.join(group)}")

    groups = check_groups(ids)
    with ThreadPoolExecutor(concurrent) as pool:
        parts = list(pool.map(counted, groups))
    return one_scan(parts, path and [f"{path}/{'-'.join(g)}" for g in groups])


def one_scan(parts: list[DataFrame], paths: list[str] | None) -> DataFrame:
    """The rows of all parts, with the folders they were read from in one scan.

    Most of their files are small, and each task of a union reports on every scan in it to the driver.
    """
    if not paths or len(paths) == 1:
        return reduce(lambda a, b: a.unionByName(b), parts)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*paths)


def write_flags(study: Study, path: str, ids: Iterable[str] = (*ARCHETYPES, *DERIVATIONS), lookup_grain: str = "record",
                concurrent: int = 6) -> DataFrame:
    """Write the flags with one job per group of checks and read them back.

    The groups are independent, so their jobs share the cluster, small ones fill gaps left by
    large ones, and a failed group can be repeated alone.  What comes back is this call's flags
    only, also where the folder holds groups of an earlier call with other ids.  The flags of a
    study that lies by subject lie by subject too, for which its groups are written one after the
    other, and facts that several groups look up are made once.
    """
    ids = tuple(ids)
    _measurements_first(study, ids)
    study = study if study.loads else study.measured()
    groups = check_groups(ids)
    if study.buckets:
        looked_up = Counter(f for g in groups for f in {f for i in g if i != "A19" for f in CHECKS[i].facts} if "USUBJID" in fx.FACTS[f][0])
        study = fx.with_facts(study, sorted(f for f, n in looked_up.items() if n > 1),
                              lambda df, name: written_by_subject(df, f"{path}/facts/{name}", study.buckets))
        return all_by_subject((run_checks(study, g, lookup_grain) for g in groups), f"{path}/by-subject", study.buckets, "subject")

    def write(group: list[str]) -> str:
        to = f"{path}/group={'-'.join(group)}"
        run_checks(study, group, lookup_grain).write.mode("overwrite").parquet(to)
        return to

    with ThreadPoolExecutor(concurrent) as pool:
        written = list(pool.map(write, groups))
    return study.spark.read.parquet(*written)
