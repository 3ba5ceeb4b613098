"""A19: overall response against the fixed response table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswitness.functions.columns import with_record_id
from crosswitness.functions.scalars import norm_response, norm_target
from crosswitness.operators.skew import keyed_join
from crosswitness.plans import facts as fx
from crosswitness.sources.study import Study

MESSAGE = "Overall response contradicts target response, non-target response and new-lesion status"


def subject_responses(study: Study) -> DataFrame:
    """Per subject: first overall, first non-target and new-lesion status.

    "First" is the lowest (VISITNUM, RSSEQ).  Without a new-lesion row the status comes
    from lesion texts that contain NEW.
    """
    code = F.upper("RSTESTCD")
    rank = F.struct(F.coalesce("VISITNUM", F.lit(float("inf"))), F.coalesce("RSSEQ", F.lit(float("inf"))), "RSORRES")

    def first(test: str, value):
        return F.min_by(value, F.when((code == test) & F.col("RSORRES").isNotNull(), rank))

    rs = study["RS"].groupBy(*study.keys).agg(
        first("OVRLRESP", F.col("RSORRES")).alias("_actual"),
        first("OVRLRESP", F.col("VISITNUM")).alias("_visit"),
        first("NTOVRLRESP", F.col("RSORRES")).alias("_nt"),
        first("NEWLEC", F.col("RSORRES")).alias("_newlec"),
    )
    return rs.join(new_lesion_text(study), list(study.keys), "left").withColumn(
        "_new",
        F.when(F.col("_newlec").isNotNull(), F.when(F.upper("_newlec") == "Y", "YES").otherwise("NO"))
        .when(F.col("_new_text"), "YES").otherwise("NO"),
    )


def new_lesion_text(study: Study, columns: tuple[str, ...] = ("TUTESTCD", "TUTEST")) -> DataFrame:
    """Whether any lesion row of the subject mentions NEW in the given columns."""
    tu = study["TU"]
    hits = [F.coalesce(F.upper(c).contains("NEW"), F.lit(False)) for c in columns if c in tu.columns]
    any_hit = F.greatest(*hits) if len(hits) > 1 else (hits[0] if hits else F.lit(False))
    return tu.groupBy(*study.keys).agg(F.bool_or(any_hit).alias("_new_text"))


def lookup_flags(study: Study, grain: str = "record") -> DataFrame:
    if grain == "record":
        return _per_record(study)
    return _per_subject(study)


def _per_record(study: Study) -> DataFrame:
    raw = study.raw("RS")
    rows = with_record_id(study["RS"], "RS", raw.columns if raw is not None else None)
    rows = rows.filter(fx.is_overall() & F.col("RSORRES").isNotNull()).withColumn("_target", norm_target(F.col("RSORRES")))
    table = fx.lookup_subject(study)
    hits = keyed_join(rows, table, [*study.keys, "_target"], "inner", study.load("RS"))
    actual = F.upper("RSORRES")
    hits = hits.filter(F.exists("_expected", lambda e: e != actual)).withColumn(
        "evidence", F.array(_pair("target_response", F.col("RSORRES")),
                            _pair("expected_overall", F.array_join(F.array_sort("_expected"), ",")),
                            _pair("actual_overall", F.col("RSORRES"))))
    return _shape(study, hits, F.col("VISITNUM").cast("string"), F.col("record_id"))


def _per_subject(study: Study) -> DataFrame:
    subjects = subject_responses(study).filter(F.col("_actual").isNotNull() & F.col("_nt").isNotNull())
    subjects = subjects.withColumn("_target", norm_target(F.col("_actual"))).withColumn("_nontarget", norm_response(F.col("_nt")))
    hits = subjects.join(F.broadcast(fx.response_table(study)), ["_target", "_nontarget", "_new"]).filter(
        F.upper("_expected") != F.upper("_actual"))
    hits = hits.withColumn("evidence", F.array(
        _pair("target_response", F.col("_actual")), _pair("nontarget_response", F.col("_nt")),
        _pair("new_lesion_status", F.col("_new")), _pair("expected_overall", F.col("_expected")),
        _pair("actual_overall", F.col("_actual"))))
    return _shape(study, hits, F.col("_visit").cast("string"), F.concat_ws("/", F.lit("RS"), "USUBJID"))


def _pair(kind: str, value):
    return F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))


def _shape(study: Study, hits: DataFrame, visit, record_id) -> DataFrame:
    return hits.select(
        *study.scope, F.col("USUBJID").alias("subject"), visit.alias("visit"), F.lit("L3").alias("layer"),
        F.lit("A19").alias("archetype"), F.lit("A19").alias("rule_id"), F.lit("RS").alias("domain"),
        record_id.alias("record_id"), F.lit("violation").alias("severity"), F.lit(MESSAGE).alias("message"),
        "evidence", F.array(F.lit("A19")).alias("core_rule_xref"), F.lit("LOOKUP").alias("source"),
    )
