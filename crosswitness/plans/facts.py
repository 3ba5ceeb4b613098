"""Facts: one-row-per-key summaries that the checks look up.

Every fact is a plain aggregate (combined map-side before its shuffle), so it stays small
and unique on its key.  Fact columns start with an underscore.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswitness.functions.scalars import exact_sum, full_date, micro, norm_response, norm_target
from crosswitness.operators.ordered import previous, running_min
from crosswitness.operators.skew import keyed_join
from crosswitness.sources.study import Study

# Fixed values: (target, non-target, new lesion) -> overall response.
OVERALL_RESPONSE = {
    ("CR", "CR", "NO"): "CR",
    ("CR", "NON-CR/NON-PD", "NO"): "PR",
    ("CR", "PD", "NO"): "PD",
    ("CR", "NE", "NO"): "PR",
    ("PR", "CR", "NO"): "PR",
    ("PR", "NON-CR/NON-PD", "NO"): "PR",
    ("PR", "PD", "NO"): "PD",
    ("PR", "NE", "NO"): "PR",
    ("SD", "CR", "NO"): "SD",
    ("SD", "NON-CR/NON-PD", "NO"): "SD",
    ("SD", "PD", "NO"): "PD",
    ("SD", "NE", "NO"): "SD",
    ("NE", "CR", "NO"): "NE",
    ("NE", "NON-CR/NON-PD", "NO"): "NE",
    ("NE", "PD", "NO"): "PD",
    ("NE", "NE", "NO"): "NE",
    ("CR", "CR", "YES"): "PD",
    ("CR", "NON-CR/NON-PD", "YES"): "PD",
    ("CR", "PD", "YES"): "PD",
    ("CR", "NE", "YES"): "PD",
    ("PR", "CR", "YES"): "PD",
    ("PR", "NON-CR/NON-PD", "YES"): "PD",
    ("PR", "PD", "YES"): "PD",
    ("PR", "NE", "YES"): "PD",
    ("PD", "CR", "YES"): "PD",
    ("PD", "NON-CR/NON-PD", "YES"): "PD",
    ("PD", "PD", "YES"): "PD",
    ("PD", "NE", "YES"): "PD",
    ("SD", "CR", "YES"): "PD",
    ("SD", "NON-CR/NON-PD", "YES"): "PD",
    ("SD", "NE", "YES"): "PD",
    ("NE", "CR", "YES"): "PD",
    ("NE", "NON-CR/NON-PD", "YES"): "PD",
    ("NE", "NE", "YES"): "PD",
}


def response_table(study_or_spark) -> DataFrame:
    spark = getattr(study_or_spark, "spark", study_or_spark)
    rows = [F.struct(*[F.lit(v) for v in (*k, o)]) for k, o in OVERALL_RESPONSE.items()]
    return spark.range(1).select(F.inline(F.array(*rows))).toDF("_target", "_nontarget", "_new", "_expected")


def is_overall() -> Column:
    return F.col("RSTESTCD") == "OVRLRESP"


def is_target_response() -> Column:
    return (F.col("RSCAT") == "TARGET RESPONSE") & (F.col("RSTESTCD") == "OVRESP")


def is_progression_text() -> Column:
    return (F.col("TRTESTCD") == "TUMSTATE") & F.upper("TRORRES").contains("UNEQUIVOCAL PROGRESSION")


def _existing(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return df.select(*keys).distinct().withColumn(flag, F.lit(True))


# -- facts about responses ---------------------------------------------------------

def rs_subject(study: Study) -> DataFrame:
    """Latest visits and dates of a subject's responses."""
    conf = is_overall() & F.col("RSORRES").isin("PR", "CR")
    icpd = is_overall() & (F.col("RSORRES") == "iCPD")
    best = is_target_response() & F.col("RSORRES").isin("PR", "CR")
    return study["RS"].groupBy(*study.keys).agg(
        F.max("VISITNUM").alias("_last_visit"),
        F.max(F.when(conf, F.col("VISITNUM"))).alias("_last_conf"),
        F.max(F.when(icpd, F.col("VISITNUM"))).alias("_last_icpd"),
        F.max(F.when(best, full_date(F.col("RSDTC")))).alias("_last_best_date"),
    )


def ovr_visit(study: Study) -> DataFrame:
    """Which overall responses a subject has at a visit."""
    return (
        study["RS"].filter(is_overall() & F.col("RSORRES").isNotNull() & F.col("VISITNUM").isNotNull())
        .groupBy(*study.keys, "VISITNUM")
        .agg(F.bool_or(F.col("RSORRES") == "SD").alias("_has_sd"),
             F.bool_or(F.col("RSORRES") != "PD").alias("_has_non_pd"))
    )


def lookup_subject(study: Study) -> DataFrame:
    """Expected overall responses per subject and target response.

    A subject contributes at most four non-target codes and two new-lesion codes, so the
    expected set is bounded by the code lists however many rows the subject has.
    """
    rs = study["RS"].filter(F.col("RSORRES").isNotNull())
    nt = (rs.filter(F.upper("RSTESTCD") == "NTOVRLRESP")
          .select(*study.keys, norm_response(F.col("RSORRES")).alias("_nontarget")).distinct())
    new = (rs.filter(F.upper("RSTESTCD") == "NEWLEC")
           .select(*study.keys, F.when(F.upper("RSORRES") == "Y", "YES").otherwise("NO").alias("_new")).distinct())
    pairs = nt.filter(F.col("_nontarget").isin("CR", "PD", "NE", "NON-CR/NON-PD")).join(new, list(study.keys))
    return (pairs.join(F.broadcast(response_table(study)), ["_nontarget", "_new"])
            .groupBy(*study.keys, "_target").agg(F.collect_set("_expected").alias("_expected")))


# -- facts about measurements -------------------------------------------------------

def tr_subject(study: Study) -> DataFrame:
    """Baseline visit and baseline sum of diameters of a subject."""
    per_visit = _tr_by_visit(study)
    return per_visit.groupBy(*study.keys).agg(
        F.min(F.when(F.col("_screening"), F.col("VISITNUM"))).alias("_baseline"),
        F.min_by(F.col("_sld"), F.when(F.col("_screening"), F.col("VISITNUM"))).alias("_base_sld"),
    )


def _tr_by_visit(study: Study) -> DataFrame:
    diameter = F.when(F.col("TRTESTCD") == "LDIAM", F.col("TRSTRESN"))
    return (
        study["TR"].filter(F.col("TRTARGETLN") & F.col("VISITNUM").isNotNull())
        .groupBy(*study.keys, "VISITNUM")
        .agg(
            exact_sum(diameter).alias("_sld"),
            F.count(diameter).alias("_measured"),
            F.count(F.when(diameter > 0, True)).alias("_positive"),
            F.count(F.when(diameter >= 0, True)).alias("_readable"),
            F.count(F.when((F.col("TRTESTCD") == "LNSADIAM") & (F.col("TRSTRESN") >= 10), True)).alias("_nodes"),
            F.coalesce(F.bool_or(F.col("EPOCH") == "SCREENING"), F.lit(False)).alias("_screening"),
        )
    )


def tr_visit(study: Study) -> DataFrame:
    """Sum of diameters, baseline and nadir as seen at each visit.

    ``_at_baseline``/``_nadir`` are NULL before the baseline visit; the nadir includes the
    current visit.
    """
    keys, load = list(study.keys), study.load("TR")
    df = _tr_by_visit(study).withColumn("_scr_visit", F.when(F.col("_screening"), F.col("VISITNUM")))
    df = running_min(df, keys, "VISITNUM", "_scr_visit", "_bl", load)
    df = df.withColumn("_since", F.when(F.col("_bl").isNotNull(), F.col("_sld")))
    df = df.withColumn("_bl_sld", F.when(F.col("VISITNUM") == F.col("_bl"), F.col("_sld")))
    df = running_min(df, keys, "VISITNUM", "_since", "_nadir", load)
    df = running_min(df, keys, "VISITNUM", "_bl_sld", "_base", load)
    return df.select(*keys, "VISITNUM", "_sld", "_measured", "_positive", "_readable", "_nodes", "_bl", "_base", "_nadir")


def shrunk_visit(study: Study) -> DataFrame:
    """Visits where some lesion is below 70% of its previous measured visit."""
    lesion = [*study.keys, "TRLNKID"]
    per_visit = (
        study["TR"]
        .filter((F.col("TRTESTCD") == "LDIAM") & F.col("TRLNKID").isNotNull() & F.col("VISITNUM").isNotNull())
        .groupBy(*lesion, "VISITNUM")
        .agg(F.min("TRSTRESN").alias("_min"), F.max("TRSTRESN").alias("_max"))
    )
    seen = previous(per_visit, lesion, "VISITNUM", "_max", "_before", study.load("TR"))
    small = seen.filter(micro(F.col("_min")) * 100 < micro(F.col("_before")) * 70)
    return _existing(small, [*study.keys, "VISITNUM"], "_shrunk")


def measurable_visit(study: Study) -> DataFrame:
    """Visits with a measurable target lesion."""
    some = study["TR"].filter((F.col("TRTESTCD") == "LDIAM") & (F.col("TRSTRESN") > 0) & F.col("VISITNUM").isNotNull())
    return _existing(some, [*study.keys, "VISITNUM"], "_measurable")


# -- facts about identified lesions ------------------------------------------------------

def tu_lesion(study: Study) -> DataFrame:
    """First visit of each lesion."""
    return (study["TU"].filter(F.col("TULNKID").isNotNull())
            .groupBy(*study.keys, "TULNKID").agg(F.min("VISITNUM").alias("_first_visit")))


def new_target_visit(study: Study) -> DataFrame:
    """Post-baseline visits with a target lesion not seen up to baseline."""
    keys = list(study.keys)
    load = study.load("TU")
    fresh = (keyed_join(fact(study, "tu_lesion"), fact(study, "tr_subject").select(*keys, "_baseline"), keys, "inner", load)
             .filter(F.col("_first_visit") > F.col("_baseline")))
    target = study["TU"].filter((F.col("TUCAT") == "TARGET LESION") & F.col("VISITNUM").isNotNull())
    rows = keyed_join(target.select(*keys, "TULNKID", "VISITNUM"), fresh, [*keys, "TULNKID"], "left_semi", load)
    return _existing(rows, [*keys, "VISITNUM"], "_new_target")


# -- facts about subjects ---------------------------------------------------------------

def ex_subject(study: Study) -> DataFrame:
    return study["EX"].groupBy(*study.keys).agg(
        F.lit(True).alias("_exposed"),
        F.min(F.when(F.length("EXSTDTC") >= 10, F.col("EXSTDTC"))).alias("_first_start"),
        F.min(F.when(F.col("EXSTDTC") != "", F.col("EXSTDTC"))).alias("_any_start"),
    )


def ex_date(source: str, target: str):
    """Existence of an exposure date, keyed so that DM's ``target`` column can look it up."""
    def build(study: Study) -> DataFrame:
        ex = study["EX"].filter(F.col(source).isNotNull())
        return _existing(ex.select(*study.keys, F.col(source).alias(target)), [*study.keys, target], f"_{target.lower()}_seen")
    return build


def ae_subject(study: Study) -> DataFrame:
    """Earliest attributed adverse event with a full date."""
    related = F.col("AEREL").isin("PROBABLE", "POSSIBLE", "Y") & (F.length("AESTDTC") >= 10)
    return study["AE"].filter(related).groupBy(*study.keys).agg(F.min(full_date(F.col("AESTDTC"))).alias("_first_related"))


def ds_subject(study: Study) -> DataFrame:
    return study["DS"].groupBy(*study.keys).agg(
        F.lit(True).alias("_disposed"),
        F.coalesce(F.bool_or(F.upper("DSDECOD").contains("DEATH")), F.lit(False)).alias("_death"),
    )


def supp_subject(study: Study) -> DataFrame:
    return (study["SUPPDM"].filter(F.upper("QNAM").contains("RACE"))
            .groupBy(*study.keys).agg(F.lit(True).alias("_race_detail")))


def dm_subject(study: Study) -> DataFrame:
    return study["DM"].groupBy(*study.keys).agg(
        F.count(F.lit(1)).alias("_dm_rows"), F.min("SEX").alias("_sex_min"), F.max("SEX").alias("_sex_max"))


def dm_arm(study: Study) -> DataFrame:
    return (study["DM"].filter(F.col("ARM").isNotNull() & F.col("ARMCD").isNotNull())
            .groupBy(*study.scope, "ARMCD").agg(F.min("ARM").alias("_arm_min"), F.max("ARM").alias("_arm_max")))


def ta_arm(study: Study) -> DataFrame:
    ta = study["TA"].filter(F.col("ARMCD").isNotNull())
    scope = [k for k in study.scope if k in ta.columns]
    return _existing(ta, [*scope, "ARMCD"], "_known_arm")


# name -> (key columns beyond the scope, builder, load to consult)
SUBJECT, VISIT = ("USUBJID",), ("USUBJID", "VISITNUM")
FACTS = {
    "rs_subject": (SUBJECT, rs_subject),
    "ovr_visit": (VISIT, ovr_visit),
    "tr_subject": (SUBJECT, tr_subject),
    "tr_visit": (VISIT, tr_visit),
    "shrunk_visit": (VISIT, shrunk_visit),
    "measurable_visit": (VISIT, measurable_visit),
    "new_target_visit": (VISIT, new_target_visit),
    "tu_lesion": (("USUBJID", "TULNKID"), tu_lesion),
    "ex_subject": (SUBJECT, ex_subject),
    "ex_rfxstdtc": (("USUBJID", "RFXSTDTC"), ex_date("EXSTDTC", "RFXSTDTC")),
    "ex_rfxendtc": (("USUBJID", "RFXENDTC"), ex_date("EXENDTC", "RFXENDTC")),
    "ex_rfstdtc": (("USUBJID", "RFSTDTC"), ex_date("EXSTDTC", "RFSTDTC")),
    "ae_subject": (SUBJECT, ae_subject),
    "ds_subject": (SUBJECT, ds_subject),
    "supp_subject": (SUBJECT, supp_subject),
    "dm_subject": (SUBJECT, dm_subject),
    "dm_arm": (("ARMCD",), dm_arm),
    "ta_arm": (("ARMCD",), ta_arm),
}


# name -> tables it reads
FACT_TABLES = {
    **dict.fromkeys(("rs_subject", "ovr_visit"), ("RS",)),
    **dict.fromkeys(("tr_subject", "tr_visit", "shrunk_visit", "measurable_visit"), ("TR",)),
    "new_target_visit": ("TU", "TR"), "tu_lesion": ("TU",),
    **dict.fromkeys(("ex_subject", "ex_rfxstdtc", "ex_rfxendtc", "ex_rfstdtc"), ("EX",)),
    "ae_subject": ("AE",), "ds_subject": ("DS",), "supp_subject": ("SUPPDM",), "dm_subject": ("DM",), "dm_arm": ("DM",), "ta_arm": ("TA",),
}


def fact(study: Study, name: str) -> DataFrame:
    """The fact of the study, or the rows it is made of already."""
    return study.facts[name][1] if name in study.facts else FACTS[name][1](study)


def with_facts(study: Study, names: Iterable[str], keep: Callable[[DataFrame, str], DataFrame]) -> Study:
    """The study with these facts made and kept (rows, name), for as long as none of their tables changes."""
    return replace(study, facts={**study.facts, **{n: (frozenset(FACT_TABLES[n]), keep(FACTS[n][1](study), n)) for n in names}})


def fact_keys(study: Study, name: str, facts: DataFrame) -> list[str]:
    return [*[k for k in study.scope if k in facts.columns], *FACTS[name][0]]


def target_of(c: Column) -> Column:
    return norm_target(c)
