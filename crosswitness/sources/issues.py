"""Issue reports of external validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.operators.skew import keyed_join, measure

# Datasets of interest, and report rows that only describe the submission.
DATASETS = ("dm.xpt", "ex.xpt", "tu.xpt", "tr.xpt", "rs.xpt")
NOISE_RULES = ("DD0101",)
ISSUE = "dataset string, USUBJID string, core_id string, message string, variables string, `values` string"
KEY = ("core_id", "dataset", "USUBJID", "message_head", "variables", "values")


def load_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issue rows of JSON reports (one ``Issue_Details`` array per file)."""
    report = spark.read.schema(f"Issue_Details array<struct<dataset:string,USUBJID:string,core_id:string,message:string,variables:string,`values`:string>>")
    return report.json(path, multiLine=True).select(F.inline("Issue_Details"))


def real_issues(issues: DataFrame) -> DataFrame:
    """Without rows that only say a rule could not be built."""
    return issues.filter(~F.lower(F.coalesce("message", F.lit(""))).contains("failed to build"))


def to_flags(issues: DataFrame, source: str, datasets: tuple[str, ...] = DATASETS) -> DataFrame:
    """Issues on the datasets of interest as flags."""
    kept = issues.filter(F.lower("dataset").isin(*datasets))
    return kept.select(
        F.coalesce("USUBJID", F.lit("")).alias("subject"), F.lit(None).cast("string").alias("archetype"),
        F.coalesce("core_id", F.lit("unknown")).alias("rule_id"), F.upper(F.substring_index("dataset", ".", 1)).alias("domain"),
        F.lit("violation").alias("severity"), F.coalesce("message", F.lit("")).alias("message"), F.lit(source).alias("source"))


def load_report_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a second validator's CSV export, without noise rules and empty rows."""
    raw = spark.read.option("header", True).csv(path)
    return clean_report_rows(raw)


def clean_report_rows(raw: DataFrame, noise: tuple[str, ...] = NOISE_RULES) -> DataFrame:
    def cell(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in raw.columns else F.lit("")

    present = F.coalesce(*[F.col(c).cast("string") for c in raw.columns]).isNotNull()
    rows = raw.filter(present).select(
        cell("Domain").alias("domain"), cell("Variables").alias("variables"), cell("Values").alias("values"),
        cell("Rule ID").alias("rule_id"), F.left(cell("Message"), F.lit(160)).alias("message"),
        cell("Category").alias("category"), cell("Severity").alias("severity"))
    return rows.filter(~F.col("rule_id").isin(*noise))


def issue_key(issues: DataFrame) -> DataFrame:
    """Issues with the comparable head of their message."""
    return issues.withColumn("message_head", F.left("message", F.lit(120)))


def new_issues(injected: DataFrame, clean: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Issues of the injected report whose key the clean report does not have.

    A NULL equals a NULL and nothing else, an empty text among the rest.  An issue that is reported
    very often keeps its rows where they are and meets the one key of the clean report there.
    """
    def keyed(df: DataFrame) -> DataFrame:
        cells = F.to_json(F.struct(*[F.col(k) for k in key]), {"ignoreNullFields": "false"})
        return issue_key(df).withColumn("_key", F.sha2(cells, 256))

    rows = keyed(injected)
    known = keyed(clean).select("_key").distinct()
    return keyed_join(rows, known, ["_key"], "left_anti", measure({"rows": (rows, ("_key",))})["rows"]).drop("_key", "message_head")
