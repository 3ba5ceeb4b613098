"""Legacy trial layouts to the standard domains.

Two layouts are covered by one set of builders driven by a configuration: the *lesion
form* (one row per lesion and visit, blank lesion id for the reported sum) and the *visit
form* (typed lesions, day offsets instead of dates).  Sequence numbers are positions in a
total order per subject.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswitness.functions import scalars as sc
from crosswitness.functions.columns import col_or_null
from crosswitness.operators.ordered import numbered, position
from crosswitness.operators.skew import ROWS_PER_TASK, Load, measure
from crosswitness.sources.staging import required_root
from crosswitness.sources.study import Study

# Code lists of the visit-form layout.
RACES = {"1": "WHITE", "2": "BLACK OR AFRICAN AMERICAN", "9": "UNKNOWN"}
RESPONSES = ("CR", "PR", "SD", "PD", "NE", "ND")
STATUS_TERMS = {"1": "DISCONTINUED", "2": "COMPLETED"}
TOXICITIES = {
    "TOXY_001": "Nausea",
    "TOXY_002": "Vomiting",
    "TOXY_003": "Diarrhea",
    "TOXY_004": "Mucositis/stomatitis",
    "TOXY_005": "Alopecia",
    "TOXY_006": "Infection",
}
SEVERITIES = {"1": "MILD", "2": "MODERATE", "3": "SEVERE"}


@dataclass(frozen=True)
class TrialConfig:
    """What differs between trials of one layout."""

    study_id: str
    screening_visit: float = 0.0
    anchor: dt.date = dt.date(2010, 1, 1)
    treatment: str = "Treatment B"
    default_arm: str = "B"
    assumed_sex: str = "F"
    loads: dict[str, Load] = field(default_factory=dict)

    def epoch(self, visit: Column) -> Column:
        return F.when(visit == self.screening_visit, "SCREENING").otherwise("TREATMENT")

    def who(self, raw: Column) -> Column:
        return sc.subject_id(self.study_id, raw)


def _with_loads(raw: dict[str, DataFrame], config: TrialConfig, rows_per_task: int = ROWS_PER_TASK) -> TrialConfig:
    """The configuration with the measured sizes of the raw tables by subject, in one job.

    A raw row can become several: four answers a response row (and a sum of the lesion rows of its
    visit), six graded events a toxicity row.  The loads are upper bounds of what gets numbered.
    """
    subject = "PT" if "lesles" in raw else "RSUBJ_ID"
    found = measure({name: (df, (subject,)) for name, df in raw.items()}, rows_per_task)
    times = lambda name, n: Load(found[name].rows * n, found[name].largest * n, rows_per_task)
    plus = lambda a, b: Load(a.rows + b.rows, a.largest + b.largest, rows_per_task)
    loads = {name: found[name] for name in ("ds", "dose", "eosr") if name in found}
    if "lesles" in raw:
        loads |= {"lesions": found["lesles"], "responses": plus(times("rsp", 4), found["lesles"])}
    else:
        loads |= {"lesions": found["lesions"], "responses": times("responses", 4), "toxy": times("toxy", 6)}
    return replace(config, loads={**loads, **config.loads})


def _sequence(df: DataFrame, out: str, order: list[str], config: TrialConfig, table: str) -> DataFrame:
    """Position per subject along ``order``; a subject of very many rows is cut by rank, so a day or visit may hold them all."""
    load, by = config.loads.get(table), [F.col(c).asc_nulls_last() for c in order]
    if load is not None and load.hot:
        out_rows = numbered(df, ["USUBJID"], by, out, f"{required_root(df.sparkSession)}/sequence")
    else:
        out_rows = position(df, ["USUBJID"], by, out, F.col(order[0]))
    return out_rows.withColumn(out, F.col(out).cast("double"))


def _first_appearance(les: DataFrame) -> DataFrame:
    """First row of each lesion, keeping the columns of that row."""
    rest = [c for c in les.columns if c not in ("USUBJID", "lesion")]
    order = F.struct("VISITNUM", *[c for c in rest if c != "VISITNUM"])
    return les.groupBy("USUBJID", "lesion").agg(F.min_by(F.struct(*rest), order).alias("r")).select("USUBJID", "lesion", "r.*")


def _tu(les: DataFrame, config: TrialConfig) -> DataFrame:
    first = _sequence(_first_appearance(les.select("USUBJID", "lesion", "VISITNUM", "target", "TULOC")), "TUSEQ",
                      ["VISITNUM", "lesion"], config, "lesions")
    return first.select(
        F.lit(config.study_id).alias("STUDYID"), "USUBJID", "VISITNUM", "TUSEQ", F.col("lesion").alias("TULNKID"),
        F.when(F.col("target"), "TARGET LESION").otherwise("NON-TARGET LESION").alias("TUCAT"), "TULOC")


def _tr(les: DataFrame, config: TrialConfig, dated: bool) -> DataFrame:
    rows = _sequence(les, "TRSEQ", ["VISITNUM", "lesion", "size", "state"], config, "lesions")
    size = F.col("size")
    columns = [
        F.lit(config.study_id).alias("STUDYID"), "USUBJID", "VISITNUM", "TRSEQ", F.col("lesion").alias("TRLNKID"),
        F.when(F.col("target"), "TARGET").otherwise("NON-TARGET").alias("TRGRPID"),
        F.when(F.col("target"), "LDIAM").otherwise("TUMSTATE").alias("TRTESTCD"),
        F.when(F.col("target"), size).alias("TRSTRESN"),
        F.when(F.col("target"), F.coalesce(size.cast("string"), F.lit(""))).otherwise(F.col("state")).alias("TRORRES"),
        F.when(F.col("not_done"), "NOT DONE").otherwise("").alias("TRSTAT"), config.epoch(F.col("VISITNUM")).alias("EPOCH"),
    ]
    return rows.select(*columns, *(["TRDTC"] if dated else []))


def _long_responses(wide: DataFrame, config: TrialConfig, sums: DataFrame | None, dated: bool) -> DataFrame:
    """Wide response rows to long rows; blank answers give no row."""
    def answer(n: int, cat: str, test: str, value: Column, number: Column = F.lit(None).cast("double")) -> Column:
        return F.struct(F.lit(n).alias("n"), F.lit(cat).alias("RSCAT"), F.lit(test).alias("RSTESTCD"), value.alias("RSORRES"), number.alias("RSSTRESN"))

    items = [answer(1, "TARGET RESPONSE", "OVRESP", F.col("trsp")), answer(2, "NON-TARGET RESPONSE", "NTRGRESP", F.col("ntrsp")),
             answer(3, "OVERALL RESPONSE", "OVRLRESP", F.col("orsp"))]
    shown = F.filter(F.array(*items), lambda a: a["RSORRES"] != "")
    keep = ["USUBJID", "VISITNUM", *(["RSDTC"] if dated else [])]
    rows = wide.select(*keep, F.explode(shown).alias("a")).select(*keep, "a.*")
    if sums is None:
        reported = wide.filter(F.col("sum").isNotNull())
        sums = reported.select(*keep, F.lit(4).alias("n"), F.lit("TARGET RESPONSE").alias("RSCAT"), F.lit("SUMDIAM").alias("RSTESTCD"),
                               F.lit("").alias("RSORRES"), F.col("sum").alias("RSSTRESN"))
    rows = rows.unionByName(sums)
    rows = _sequence(rows, "RSSEQ", ["VISITNUM", *(["RSDTC"] if dated else []), "n", "RSORRES", "RSSTRESN"], config, "responses")
    return rows.select(
        F.lit(config.study_id).alias("STUDYID"), "USUBJID", "VISITNUM", "RSSEQ", "RSCAT", "RSTESTCD", "RSORRES",
        F.col("RSORRES").alias("RSSTRESC"), "RSSTRESN", *(["RSDTC"] if dated else []), config.epoch(F.col("VISITNUM")).alias("EPOCH"))


def _arms(named: DataFrame, config: TrialConfig) -> DataFrame:
    """Trial arms from distinct (ARM, ARMCD), numbered by name."""
    arms = named.filter(F.col("ARM") != "").select("ARM", "ARMCD").distinct()
    arms = numbered(arms, [], [F.col("ARM").asc(), F.col("ARMCD").asc()], "i", f"{required_root(named.sparkSession)}/arms")
    return arms.select(
        F.lit(config.study_id).alias("STUDYID"), "ARMCD", "ARM", F.lit(1.0).alias("TAETORD"),
        F.concat(F.lit("EL"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("ETCD"),
        F.lit("Treatment").alias("ELEMENT"), F.col("i").cast("double").alias("TASEQ"))


# -- lesion form ----------------------------------------------------------------------------

def lesion_form_lesions(lesles: DataFrame, config: TrialConfig) -> DataFrame:
    lesion = sc.blank(F.col("LESID"))
    return lesles.filter(lesion != "").select(
        config.who(F.col("PT")).alias("USUBJID"), F.col("VISITNUM").cast("double").alias("VISITNUM"), lesion.alias("lesion"),
        sc.is_target_lesion(lesion).alias("target"), F.coalesce(col_or_null(lesles, "LESSIT"), F.lit("")).alias("TULOC"),
        F.col("LNGDIA").cast("double").alias("size"), F.coalesce(col_or_null(lesles, "LESEVL"), F.lit("")).alias("state"),
        (F.upper(sc.blank(col_or_null(lesles, "NDONE"))) == "NOT DONE").alias("not_done"))


def lesion_form_sums(lesles: DataFrame, config: TrialConfig) -> DataFrame:
    """Reported sum per visit, else the sum of target diameters."""
    lesion = sc.blank(F.col("LESID"))
    target = (lesion != "") & sc.is_target_lesion(lesion)
    return (lesles.groupBy(config.who(F.col("PT")).alias("USUBJID"), F.col("VISITNUM").cast("double").alias("VISITNUM"))
            .agg(F.max(F.when(lesion == "", F.col("DIASUM").cast("double"))).alias("reported"),
                 F.sum(F.when(target, F.col("LNGDIA").cast("double"))).alias("computed"))
            .select("USUBJID", "VISITNUM", F.lit(4).alias("n"), F.lit("TARGET RESPONSE").alias("RSCAT"), F.lit("SUMDIAM").alias("RSTESTCD"),
                    F.lit("").alias("RSORRES"), F.coalesce("reported", "computed").alias("RSSTRESN"))
            .filter(F.col("RSSTRESN").isNotNull()))


def map_lesion_form(raw: dict[str, DataFrame], config: TrialConfig, measured: bool = False) -> Study:
    """Tables ``lesles``, ``rsp``, ``dm`` and ``ds`` to TU, TR, RS, DM, TA and DS."""
    config = _with_loads(raw, config) if measured else config
    lesles, rsp, dm, ds = (raw[k] for k in ("lesles", "rsp", "dm", "ds"))
    les = lesion_form_lesions(lesles, config)
    wide = rsp.select(config.who(F.col("PT")).alias("USUBJID"), F.col("VISITNUM").cast("double").alias("VISITNUM"),
                      sc.blank(F.col("TRSP")).alias("trsp"), sc.blank(F.col("NTRSP")).alias("ntrsp"), sc.blank(F.col("ORSP")).alias("orsp"))
    people = dm.groupBy("PT").agg(F.min(F.struct(
        F.col("AGE").cast("double").alias("AGE"), F.coalesce("SEX", F.lit("")).alias("SEX"), F.coalesce("RACE", F.lit("")).alias("RACE"),
        F.coalesce("TRTP", F.lit("")).alias("ARM"))).alias("p"))
    people = people.select(F.lit(config.study_id).alias("STUDYID"), config.who(F.col("PT")).alias("USUBJID"), "p.AGE", "p.SEX", "p.RACE",
                           "p.ARM", sc.arm_code(F.col("p.ARM")).alias("ARMCD"))
    arms = dm.select(F.coalesce("TRTP", F.lit("")).alias("ARM")).withColumn("ARMCD", sc.arm_code(F.col("ARM")))
    dispositions = ds.filter(sc.blank(F.col("DSDECOD")) != "").select(
        config.who(F.col("PT")).alias("USUBJID"), "DSDECOD", F.coalesce("DSCAT", F.lit("")).alias("DSCAT"), F.coalesce("EPOCH", F.lit("")).alias("EPOCH"))
    out_ds = _sequence(dispositions, "DSSEQ", ["EPOCH", "DSCAT", "DSDECOD"], config, "ds").select(F.lit(config.study_id).alias("STUDYID"), "USUBJID", F.col("DSSEQ").cast("double").alias("DSSEQ"), "DSDECOD", "DSCAT", "EPOCH")
    return Study(lesles.sparkSession, {
        "TU": _tu(les, config), "TR": _tr(les, config, dated=False),
        "RS": _long_responses(wide, config, lesion_form_sums(lesles, config), dated=False),
        "DM": people, "TA": _arms(arms, config), "DS": out_ds})


# -- visit form ------------------------------------------------------------------------------

def visit_form_lesions(lesions: DataFrame, config: TrialConfig) -> DataFrame:
    target = F.lower(sc.blank(F.col("LESTYPE"))).startswith("target")
    number = F.coalesce(F.col("LESNUM").try_cast("double").cast("bigint").cast("string"), F.col("LESNUM").cast("string"))
    size = F.col("TGTSIZE").cast("double")
    return lesions.filter(F.col("LESNUM").isNotNull()).select(
        config.who(F.col("RSUBJ_ID")).alias("USUBJID"), F.col("VISIT_ID").cast("double").alias("VISITNUM"),
        F.concat(F.when(target, "T").otherwise("NT"), number).alias("lesion"), target.alias("target"),
        F.coalesce(col_or_null(lesions, "LESLOC"), F.lit("")).alias("TULOC"), size.alias("size"),
        sc.tumour_state(col_or_null(lesions, "QUAN")).alias("state"), (target & size.isNull()).alias("not_done"),
        sc.from_offset(F.col("EXAMDAY"), config.anchor).alias("TRDTC"))


def _code(c: Column) -> Column:
    up = F.upper(sc.blank(c))
    return F.when(up.isin(*RESPONSES), up).otherwise("")


def visit_form_exposure(dose: DataFrame, config: TrialConfig) -> DataFrame:
    rows = dose.select(
        config.who(F.col("RSUBJ_ID")).alias("USUBJID"), F.col("DOSEDAY_001").cast("double").alias("day"),
        sc.from_offset(F.col("DOSEDAY_001"), config.anchor).alias("EXSTDTC"), sc.from_offset(F.col("DOSEDAY_003"), config.anchor).alias("EXENDTC"),
    ).filter((F.col("EXSTDTC") != "") | (F.col("EXENDTC") != ""))
    return _sequence(rows, "EXSEQ", ["day", "EXENDTC"], config, "dose").select(
        F.lit(config.study_id).alias("STUDYID"), "USUBJID", "EXSEQ", F.lit(config.treatment).alias("EXTRT"), "EXSTDTC", "EXENDTC",
        F.lit("TREATMENT").alias("EPOCH"))


def visit_form_events(toxy: DataFrame, config: TrialConfig) -> DataFrame:
    """One event per graded toxicity column."""
    graded = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(term).alias("term"), sc.blank(F.col(c)).alias("grade"))
                       for n, (c, term) in enumerate(TOXICITIES.items())])
    rows = toxy.select(config.who(F.col("RSUBJ_ID")).alias("USUBJID"), F.col("TOXYDAY_000").cast("double").alias("day"),
                       sc.from_offset(F.col("TOXYDAY_000"), config.anchor).alias("AESTDTC"), F.explode(graded).alias("g"))
    rows = rows.select("USUBJID", "day", "AESTDTC", "g.*").filter(F.col("grade").isin(*SEVERITIES))
    return _sequence(rows, "AESEQ", ["day", "n", "grade"], config, "toxy").select(
        F.lit(config.study_id).alias("STUDYID"), "USUBJID", "AESEQ", F.col("term").alias("AETERM"), F.col("term").alias("AEDECOD"),
        F.col("grade").alias("AETOXGR"), sc.code_map(F.col("grade"), SEVERITIES).alias("AESEV"), "AESTDTC", F.lit("TREATMENT").alias("EPOCH"))


def map_visit_form(raw: dict[str, DataFrame], config: TrialConfig, measured: bool = False) -> Study:
    """Tables ``lesions``, ``responses``, ``demo``, ``eosr``, ``toxy`` and ``dose`` to all domains."""
    config = _with_loads(raw, config) if measured else config
    les = visit_form_lesions(raw["lesions"], config)
    wr = raw["responses"]
    wide = wr.select(config.who(F.col("RSUBJ_ID")).alias("USUBJID"), F.col("VISIT_ID").cast("double").alias("VISITNUM"),
                     sc.from_offset(F.col("EXAMDAY"), config.anchor).alias("RSDTC"), _code(F.col("TGTRESP")).alias("trsp"),
                     _code(F.col("NTGTRESP")).alias("ntrsp"), _code(F.col("ALLRESP")).alias("orsp"), F.col("SUMTGT").cast("double").alias("sum"))
    ex = visit_form_exposure(raw["dose"], config)
    arm = F.when(sc.blank(F.col("ELIG_007")) == "", config.default_arm).otherwise(sc.blank(F.col("ELIG_007")))
    people = raw["demo"].groupBy("RSUBJ_ID").agg(F.min(F.struct(
        F.col("AGE").cast("double").alias("AGE"), sc.blank(F.col("RACE_GEN")).alias("race"), arm.alias("arm"))).alias("p"))
    refs = ex.groupBy("USUBJID").agg(F.min(F.nullif("EXSTDTC", F.lit(""))).alias("first"), F.max(F.nullif("EXENDTC", F.lit(""))).alias("last"))
    label = F.concat(F.lit("Treatment "), F.col("p.arm"))
    first = F.coalesce("first", F.lit(""))
    dm = people.withColumn("USUBJID", config.who(F.col("RSUBJ_ID"))).join(refs, "USUBJID", "left").select(
        F.lit(config.study_id).alias("STUDYID"), "USUBJID", "p.AGE", F.lit(config.assumed_sex).alias("SEX"),
        sc.code_map(F.col("p.race"), RACES, "UNKNOWN").alias("RACE"), label.alias("ARM"), F.col("p.arm").alias("ARMCD"),
        label.alias("ACTARM"), F.col("p.arm").alias("ACTARMCD"), first.alias("RFSTDTC"), first.alias("RFXSTDTC"),
        F.coalesce("last", F.lit("")).alias("RFXENDTC"))
    arms = raw["demo"].select(arm.alias("ARMCD")).withColumn("ARM", F.concat(F.lit("Treatment "), F.col("ARMCD")))
    status = sc.code_map(sc.blank(F.col("EOSR_003")), STATUS_TERMS, "OTHER")
    ended = raw["eosr"].select(config.who(F.col("RSUBJ_ID")).alias("USUBJID"), F.col("EOSRDAY_001").cast("double").alias("day"), status.alias("DSDECOD"),
                               F.coalesce(F.col("EOSR_004").cast("string"), F.lit("")).alias("DSTERM"),
                               sc.from_offset(F.col("EOSRDAY_001"), config.anchor).alias("DSSTDTC"))
    ds = _sequence(ended, "DSSEQ", ["day", "DSDECOD", "DSTERM"], config, "eosr").select(
        F.lit(config.study_id).alias("STUDYID"), "USUBJID", "DSSEQ", "DSDECOD", F.lit("DISPOSITION EVENT").alias("DSCAT"), "DSTERM", "DSSTDTC",
        F.lit("TREATMENT").alias("EPOCH"))
    return Study(les.sparkSession, {
        "TU": _tu(les, config), "TR": _tr(les, config, dated=True), "RS": _long_responses(wide, config, None, dated=True),
        "DM": dm, "TA": _arms(arms, config), "DS": ds, "AE": visit_form_events(raw["toxy"], config), "EX": ex})
