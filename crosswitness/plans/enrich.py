"""Enrichment and restriction of studies ahead of the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswitness.operators.skew import keyed_join
from crosswitness.sources.study import Study

TARGET_RESPONSES = ("CR", "PR", "SD", "PD", "NE")


def eligible_subjects(study: Study) -> DataFrame:
    """Subjects with at least one overall response on the target axis."""
    return study["RS"].filter(
        (F.upper("RSTESTCD") == "OVRLRESP") & F.upper("RSORRES").isin(*TARGET_RESPONSES)).select(*study.keys).distinct()


def new_lesion_status(study: Study) -> DataFrame:
    """Y for subjects with NEW in any lesion text column of TU or TR."""
    out = None
    for domain, columns in (("TU", ("TUORRES", "TUSTRESC", "TULNKID")), ("TR", ("TRGRPID", "TRLNKID"))):
        df = study.raw(domain)
        columns = [c for c in columns if df is not None and c in df.columns]
        if not columns:
            continue
        hit = F.greatest(*[F.coalesce(F.upper(c).contains("NEW"), F.lit(False)) for c in columns], F.lit(False))
        part = df.filter(hit).select(*study.keys).distinct()
        out = part if out is None else out.unionByName(part)
    if out is None:  # no text column at all: nobody has a new lesion
        out = study["RS"].select(*study.keys).limit(0)
    return out.distinct().withColumn("_newlec", F.lit("Y"))


def enrich_responses(study: Study, blanket: bool = False) -> Study:
    """Add a fixed non-target response row and a new-lesion row per subject.

    By default only eligible subjects get them and the new-lesion value comes from the
    lesion texts; ``blanket`` gives every subject the rows with value N.  The added rows
    copy the subject's first response row; sequence numbers continue after the subject's
    last one.
    """
    keys = list(study.keys)
    rs = study.raw("RS")
    order = F.struct(*[F.col(c) for c in ("VISITNUM", "RSSEQ") if c in rs.columns], F.col("RSTESTCD"))
    base = rs.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in rs.columns if c not in keys]), order).alias("_row"),
        F.max("RSSEQ").alias("_last"))
    if blanket:
        base = base.withColumn("_newlec", F.lit("N"))
    else:
        base = base.join(eligible_subjects(study), keys, "left_semi").join(new_lesion_status(study), keys, "left")
        base = base.withColumn("_newlec", F.coalesce("_newlec", F.lit("N")))
    extra = base.withColumn("_x", F.explode(F.array(
        F.struct(F.lit(1).alias("n"), F.lit("NTOVRLRESP").alias("test"), F.lit("NON-CR/NON-PD").alias("value")),
        F.struct(F.lit(2).alias("n"), F.lit("NEWLEC").alias("test"), F.col("_newlec").alias("value")))))
    changed = {"RSTESTCD": F.col("_x.test"), "RSORRES": F.col("_x.value"), "RSSTRESC": F.col("_x.value"),
               "RSSEQ": (F.col("_last") + F.col("_x.n"))}
    types = dict(rs.dtypes)
    rows = extra.select(*[
        (F.col(c) if c in keys else changed[c].cast(types[c]) if c in changed else F.col(f"_row.{c}")).alias(c) for c in rs.columns])
    return study.with_tables(RS=rs.unionByName(rows))


def restrict(study: Study, subjects: DataFrame) -> Study:
    """Keep the given subjects in every subject table; trial-design tables stay whole."""
    who = subjects.select(*study.keys).distinct()
    return study.with_tables(**{
        d: (keyed_join(df, who, list(study.keys), "left_semi", study.load(d)) if set(study.keys) <= set(df.columns) else df)
        for d, df in study.tables.items()})


def replicate(study: Study, copies: int) -> Study:
    """The cohort ``copies`` times; copy i > 0 has ``_R<i>`` appended to its subject ids."""
    def grow(df: DataFrame) -> DataFrame:
        n = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        who = F.when(F.col("_n") == 0, F.col("USUBJID")).otherwise(F.concat(F.col("USUBJID"), F.lit("_R"), F.col("_n").cast("string")))
        return df.withColumn("_n", n).withColumn("USUBJID", who).drop("_n")
    return study.with_tables(**{d: (grow(df) if "USUBJID" in df.columns else df) for d, df in study.tables.items()})


def pivot_qualifiers(study: Study, names: list[str]) -> DataFrame:
    """Supplemental qualifiers as columns ``SUPP_<name>``, smallest value on repeats."""
    return study["SUPPDM"].groupBy(*study.keys).agg(
        *[F.min(F.when(F.col("QNAM") == n, F.col("QVAL"))).alias(f"SUPP_{n}") for n in names])


def pick_subjects(study: Study, n: int, seed: int | None = None) -> DataFrame:
    """First n subjects by id, or n subjects by seeded hash order."""
    who = study["DM"].select(*study.keys).distinct()
    order = [F.col("USUBJID")] if seed is None else [F.xxhash64("USUBJID", F.lit(seed)), F.col("USUBJID")]
    return who.orderBy(*order).limit(n)
