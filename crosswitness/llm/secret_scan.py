"""Secret scan: candidates from the whole text, judged by a random forest trained on labelled findings.

Candidates are all runs of value characters in a white-space-delimited token, each with the name and
sign before it, glued (``"name":"value"``, ``name=value``) or spaced: runs of at least 12 characters, of 8
that mix letters and digits or are assigned to a name, of 4 that are assigned to a secret's name,
and key-file headers.  The forest sees length, character classes and the transitions between them, coverage by a small
dictionary, the kind of path (the document's source) and the neighbouring words.  Labelled findings
come from the caller, or from plain cases in the documents: a long unbroken value assigned to
a secret's name is a secret; addresses, dotted and pure numbers are false positives.  What is
neither is unlabelled and only scored.  Everything runs as DataFrame expressions and Spark's
own forest.

Defined results: null and empty texts have no findings; repeated rows give repeated findings; a
null source or neighbour counts as empty; without findings of both labels the score is the
share of secrets among the labelled ones, or 0.5; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.llm.common import only, table, work_folder, write_table
from crosswitness.llm.labels import SAMPLE, fold

#: Least lengths: of any run, of a mixed or assigned one, of one assigned to a secret's name.
MIN_LENGTH, MIN_MIXED, MIN_NAMED, THRESHOLD = 12, 8, 4, 0.5
TREES, DEPTH = 20, 6
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key")
DICTIONARY = (
    "the", "and", "for", "with", "from", "this", "that", "mail", "com", "org", "net", "www", "http", "https", "example", "test", "sample", "user", "name", "admin",
    "file", "page", "index", "html", "image", "version", "license", "copyright", "public", "general", "placeholder", "changeme", "your", "default", "localhost", "dummy",
)
FEATURES = ("length", "digits", "upper", "lower", "hex", "other", "distinct", "transitions", "longest_run", "dictionary", "assigned", "named", "quoted", "prev_length", "next_length", "path_depth", "path_digits", "header")


_NAME, _SIGN, _QUOTE = r"[A-Za-z_][A-Za-z0-9_-]*+", r":=|=|:", r"[\"'`\\]*+"
#: A name and a sign, if any, and a run of value characters; "=" belongs to a run only as its padding.
RUN = rf"(?:({_NAME})?{_QUOTE}({_SIGN}){_QUOTE})?([A-Za-z0-9+/_.@-]{{{MIN_NAMED},}}+(?:={{1,2}}(?![A-Za-z0-9+/_.@=-]))?)"
#: A token that assigns the next one.
ASSIGNS = rf"^[^A-Za-z0-9_]*+({_NAME}){_QUOTE}({_SIGN})$"
HEADER = "^-----BEGIN"


def findings(docs: DataFrame, text: str = "text", id: str = "doc_id", path: str = "source") -> DataFrame:
    """Candidates: doc_id, place (number of the token), part (number of the run in it), token, value, path, before (sign or token before), name, after."""
    d = only(docs, doc_id=id, text=text, path=path).select("doc_id", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.split(F.col("text").cast("string"), r"\s+").alias("t"))
    near = lambda t, i, by: F.coalesce(F.get(t, i + by), F.lit(""))
    struct = lambda x, i: F.struct(i.alias("place"), x.alias("token"), near("t", i, -1).alias("before"), near("t", i, -2).alias("name"), near("t", i, 1).alias("after"))
    hopeful = lambda x, i: (F.length(x) >= MIN_NAMED) & ((F.length(x) >= MIN_LENGTH) | x.rlike("[0-9=:]") | x.rlike(HEADER) | near("t", i, -1).rlike("[=:]$"))
    found = F.array_compact(F.transform("t", lambda x, i: F.when(hopeful(x, i), struct(x, i))))
    rows = d.select("doc_id", "path", F.explode_outer(found).alias("f")).where("f IS NOT NULL").select("doc_id", "path", "f.*")
    rows = rows.select("*", F.posexplode(F.regexp_extract_all("token", F.lit(RUN), F.lit(0))).alias("part", "run"))
    group = lambda n: F.regexp_extract("run", RUN, n)
    rows = rows.select("*", group(1).alias("own_name"), group(2).alias("sign"), group(3).alias("value"), F.regexp_extract("before", ASSIGNS, 1).alias("near_name"), F.regexp_extract("before", ASSIGNS, 2).alias("near_sign"))
    first, glued, spaced = F.col("part") == 0, F.col("sign") != "", F.col("near_sign") != ""
    before = F.when(glued, F.col("sign")).when(~first, "").when(spaced, F.col("near_sign")).otherwise(F.col("before"))
    # A sign that opens the token has its name in the token before.
    name = (F.when(glued & (F.col("own_name") != ""), F.col("own_name")).when(~first, "").when(glued, F.col("before"))
            .when(spaced, F.col("near_name")).otherwise(F.col("name")))
    rows = rows.select("doc_id", "place", "part", "token", "value", "path", before.alias("before"), name.alias("name"), "after")
    n, mixed = F.length("value"), F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    assigned, named = F.col("before").isin("=", ":", ":="), bare(F.col("name")).isin(*SECRET_NAMES)
    return rows.where((n >= MIN_LENGTH) | ((n >= MIN_MIXED) & (mixed | assigned)) | (assigned & named) | F.col("value").rlike(HEADER))


def bare(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z_-]+", "")


def plain_label(value: Column, before: Column, name: Column) -> Column:
    """1, 0 or null by the plain cases."""
    assigned = before.isin("=", ":", ":=") & bare(name).isin(*SECRET_NAMES)
    harmless = value.rlike(r"^[^@]+@[^@]+\.[A-Za-z]+$") | value.rlike(r"^[0-9.]+$")
    return F.when(assigned & value.rlike(r"^[A-Za-z0-9+/_=-]{20,}$"), 1).when(harmless, 0)


def featured(found: DataFrame) -> DataFrame:
    v, n = F.col("value"), F.length("value").cast("double")
    count = lambda chars: (F.length(v) - F.length(F.regexp_replace(v, chars, ""))) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0")
    runs = F.split(F.regexp_replace(kinds, r"(.)(?!\1)", "$1 "), " ")
    parts = F.split(F.lower(v), "[^a-z]+")
    covered = F.aggregate(F.filter(parts, lambda x: x.isin(*DICTIONARY)), F.lit(0), lambda a, x: a + F.length(x))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    columns = {
        "length": F.log1p(n), "digits": count("[0-9]"), "upper": count("[A-Z]"), "lower": count("[a-z]"), "hex": count("[0-9a-fA-F]"), "other": count("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n, "transitions": F.size(runs) / n, "longest_run": F.array_max(F.transform(runs, lambda x: F.length(x))) / n,
        "dictionary": covered / n, "assigned": flag(F.col("before").isin("=", ":", ":=")), "named": flag(bare(F.col("name")).isin(*SECRET_NAMES)), "header": flag(v.rlike(HEADER)),
        "quoted": flag(F.col("token").rlike("[\"'`]")), "prev_length": F.length("before").cast("double"), "next_length": F.length("after").cast("double"),
        "path_depth": F.size(F.split("path", "[/.]")).cast("double"), "path_digits": flag(F.col("path").rlike("[0-9]")),
    }
    return found.select("*", *[c.cast("double").alias(f"x_{k}") for k, c in columns.items()])


def judged(rows: DataFrame, usable: Column, bound: int = SAMPLE) -> DataFrame:
    """Written rows of ``featured`` with a ``label`` column, scored by a forest fitted on at most ``bound`` usable labelled ones."""
    inputs = [f"x_{k}" for k in FEATURES]
    labelled = rows.where(F.col("label").isNotNull() & usable).select("label", *inputs, F.xxhash64("doc_id", "place", "value").alias("h"))
    chosen = labelled.orderBy("h", *inputs).limit(bound).select(F.col("label").cast("double").alias("label"), *inputs).cache()
    n, good = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not n or good in (0, n):
        out = rows.withColumn("score", F.lit(good / n if n else 0.5))
    else:
        vectors = VectorAssembler(inputCols=inputs, outputCol="features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featuresCol="features", labelCol="label").fit(vectors.transform(chosen))
        out = forest.transform(vectors.transform(rows.withColumnRenamed("label", "given")))
        out = out.withColumn("score", vector_to_array("probability")[1]).withColumnRenamed("given", "label")
    return out.withColumn("secret", F.col("score") >= THRESHOLD)


def scanned(spark: SparkSession, docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Every finding with its score; ``labels`` (doc_id, place, part, label) are findings judged by hand, else the plain cases are used.

    A label is about one run of a token; of contradicting labels of a run the larger counts.
    """
    found = findings(docs)
    if labels is None:
        rows = found.withColumn("label", plain_label(F.col("value"), F.col("before"), F.col("name")))
    else:
        run = ["doc_id", "place", "part"]
        given = only(labels, label="label", **{c: c for c in run}).groupBy(*run).agg(F.max("label").cast("int").alias("label"))
        rows = found.join(given, run, "left")
    rows = write_table(featured(rows), f"{work_folder(spark)}/findings")
    return judged(rows, fold(F.col("doc_id"), 5) != 0)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("place").cast("bigint").alias("place"), F.col("part").cast("bigint").alias("part"), F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("bigint").alias("length"),
                      "label", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "secret")


QUERIES = {"op9_secret_scan": op9_secret_scan}
SQL = {}
