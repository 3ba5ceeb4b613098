"""Structural checks outside the rule table: keys, code lists, sums, applicability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswitness.functions.columns import record_key
from crosswitness.functions.scalars import exact_sum, micro
from crosswitness.operators.skew import keyed_join
from crosswitness.sources.study import DOMAINS, Study

# Code lists.
CODES = {
    ("TR", "TRGRPID"): ("TARGET", "NON-TARGET"),
    ("TR", "TRTESTCD"): ("LDIAM", "LNSADIAM", "TUMSTATE"),
    ("RS", "RSORRES"): ("CR", "PR", "SD", "PD", "NE", "ND", "iCPD", "NON-CR/NON-PD"),
}


def orphan_relations(study: Study) -> DataFrame:
    """Relationship rows whose (domain, subject) has no record."""
    known = None
    for domain in DOMAINS:
        df = study.raw(domain)
        if df is None or "USUBJID" not in df.columns:
            continue
        part = df.select(*study.scope, F.lit(domain).alias("RDOMAIN"), "USUBJID").distinct()
        known = part if known is None else known.unionByName(part)
    return keyed_join(study["RELREC"], known, [*study.scope, "RDOMAIN", "USUBJID"], "left_anti", study.load("RELREC"))


def orphan_lesions(study: Study) -> DataFrame:
    """Measurements whose lesion link is not identified."""
    keys = list(study.keys)
    known = study["TU"].select(*keys, F.col("TULNKID").alias("TRLNKID")).distinct()
    rows = study["TR"].filter(F.col("TRLNKID").isNotNull())
    return keyed_join(rows, known, [*keys, "TRLNKID"], "left_anti", study.load("TR"))


def unknown_subjects(study: Study) -> DataFrame:
    """(domain, subject) pairs without a demographics record."""
    known = study["DM"].select(*study.keys).distinct()
    out = None
    for domain in DOMAINS:
        df = study.raw(domain)
        if domain == "DM" or df is None or "USUBJID" not in df.columns:
            continue
        part = df.select(*study.keys).distinct().withColumn("domain", F.lit(domain))
        out = part if out is None else out.unionByName(part)
    return out.join(known, list(study.keys), "left_anti")


def off_list_codes(study: Study, codes: dict | None = None) -> DataFrame:
    """Values outside their code list, counted; each table is read once."""
    out = None
    by_domain: dict[str, list] = {}
    for (domain, column), values in (codes or CODES).items():
        by_domain.setdefault(domain, []).append((column, values))
    for domain, columns in by_domain.items():
        bad = [F.when(F.col(c).isNotNull() & (F.col(c) != "") & ~F.col(c).isin(*values),
                      F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, values in columns]
        part = (study[domain].select(F.explode(F.array(*bad)).alias("x")).filter(F.col("x").isNotNull())
                .groupBy(F.lit(domain).alias("domain"), F.col("x.column").alias("column"), F.col("x.value").alias("value")).count())
        out = part if out is None else out.unionByName(part)
    return out


def sum_match_rate(study: Study, tolerance: float = 1.0) -> DataFrame:
    """Share of visits whose reported sum of diameters agrees with the measurements."""
    keys = [*study.keys, "VISITNUM"]
    measured = study["TR"].filter((F.col("TRTESTCD") == "LDIAM") & F.col("TRSTRESN").isNotNull()).groupBy(*keys).agg(
        exact_sum(F.col("TRSTRESN")).alias("_sum"))
    reported = study["RS"].filter((F.col("RSTESTCD") == "SUMDIAM") & F.col("RSSTRESN").isNotNull()).select(*keys, "RSSTRESN")
    both = keyed_join(reported, measured, keys, "inner", study.load("RS"))
    agree = F.abs(micro(F.col("_sum")) - micro(F.col("RSSTRESN"))) <= micro(F.lit(tolerance))
    return both.agg(F.count(F.lit(1)).alias("visits"), F.count_if(agree).alias("matching")).withColumn(
        "rate", F.when(F.col("visits") > 0, F.col("matching") / F.col("visits")))


def duplicate_records(study: Study, domain: str) -> DataFrame:
    """Record keys used by more than one row."""
    raw = study.raw(domain)
    df = raw if raw is not None else study[domain]
    return (df.select(*study.keys, record_key(df, domain).alias("record_key"))
            .groupBy(*study.keys, "record_key").count().filter("count > 1"))


def new_lesion_counts(study: Study, lesions: DataFrame) -> DataFrame:
    """Lesions first identified after baseline against the source's new-lesion marks.

    ``lesions``: subject, lesion, new (yes/no), one or more rows per lesion.
    """
    base = study["TR"].filter(F.col("EPOCH") == "SCREENING").groupBy(*study.keys).agg(F.min("VISITNUM").alias("_base"))
    first = study["TU"].groupBy(*study.keys, "TULNKID").agg(F.min("VISITNUM").alias("_first"))
    ours = first.join(base, list(study.keys)).agg(F.count_if(F.col("_first") > F.col("_base")).alias("mapped_new"))
    theirs = lesions.groupBy("subject", "lesion").agg(F.bool_or(F.upper("new").isin("Y", "YES")).alias("_new")).agg(
        F.count_if("_new").alias("source_new"))
    return ours.select(F.lit(1).alias("_k"), "mapped_new").join(theirs.select(F.lit(1).alias("_k"), "source_new"), "_k").select(
        "mapped_new", "source_new", (F.col("mapped_new") == F.col("source_new")).alias("equal"))


def not_applicable(study: Study) -> DataFrame:
    """Checks this study cannot exercise, with the reason.

    One aggregate row per table decides; an absent table or column needs no scan.
    """
    rs, ae, dm, ex = (study.raw(d) for d in ("RS", "AE", "DM", "EX"))
    spark = study.spark

    def any_row(df, cond, name):
        if df is None:
            return spark.range(1).select(F.lit(1).alias("_k"), F.lit(False).alias(name))
        return df.agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias(name)).select(F.lit(1).alias("_k"), name)

    dated = any_row(rs if rs is not None and "RSDTC" in rs.columns else None,
                    F.col("RSDTC").rlike(r"^\d{4}-\d{2}-\d{2}"), "dates")
    attributed = any_row(ae if ae is not None and "AEREL" in ae.columns else None,
                         F.upper("AEREL").isin("Y", "PROBABLE", "POSSIBLE"), "attributed")
    codes = any_row(rs if rs is not None and "RSTESTCD" in rs.columns else None, F.upper("RSTESTCD") == "NTOVRLRESP", "nontarget").join(
        any_row(rs if rs is not None and "RSTESTCD" in rs.columns else None, F.upper("RSTESTCD") == "NEWLEC", "newlec"), "_k")
    exposed, events = any_row(ex, F.lit(True), "exposed"), any_row(ae, F.lit(True), "events")
    facts = dated.join(attributed, "_k").join(exposed, "_k").join(events, "_k").join(codes, "_k").withColumn(
        "arms", F.lit(dm is not None and "ACTARMCD" in dm.columns))

    def miss(check: str, cond, reason):
        return F.when(cond, F.struct(F.lit(check).alias("check_id"), reason.alias("reason")))

    has = F.col
    rows = [
        miss("A03", ~has("attributed"), F.when(~has("events"), "no adverse events").otherwise("adverse events carry no attribution")),
        miss("A07", ~has("dates"), F.lit("responses carry no full dates")),
        miss("A20", ~has("dates"), F.lit("responses carry no full dates")),
        miss("A09", ~has("arms"), F.lit("actual arm is not recorded")),
        *[miss(a, ~has("exposed"), F.lit("no exposure records")) for a in ("A10", "A11", "A15")],
        miss("A19", ~(has("nontarget") & has("newlec")), F.lit("responses carry no non-target response or new-lesion answer")),
        miss("A14", ~(has("exposed") & has("arms")), F.lit("exposure or actual arm is not recorded")),
    ]
    return facts.select(F.explode(F.array(*rows)).alias("x")).filter(F.col("x").isNotNull()).select("x.*")

