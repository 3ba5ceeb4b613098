"""URL filtering with association rules mined by FP-growth.

Pages that an explicit rule judges are the labelled ones.  Each becomes a set of URL tokens
(parts of the host, first word of the path, ending, query keys) plus its verdict, and Spark's
FP-growth mines the frequent sets.  Rules "tokens imply verdict" are kept when support and
confidence are high enough and no rule with fewer tokens says the same at least as surely.
Every other page is matched through an inverted index: a rule is filed under its rarest token,
and a page that has that token is checked for the rest.  The most confident rule wins; pages
without one are allowed.

Defined results: a null url or one without "://" has an empty host and path, fits no rule, and
is allowed; of equally sure rules the one with more tokens, then the block, then the
alphabetically first wins; repeated pages get repeated rows; with no labelled page, or an
empty table, nothing is mined; other columns are never read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.llm.common import LOWER, UPPER, only, table, work_folder, write_table

#: (verdict, host, path) of the explicit rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A mined rule covers this share of the labelled pages and is right this often; it has at most so many tokens.  Tokens of
#: nearly all pages say nothing and are left out.
MIN_SUPPORT, MAX_SUPPORT, MIN_CONFIDENCE, MAX_TOKENS = 0.005, 0.95, 0.8, 3
VERDICT = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def explicit(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict); null if none does."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(
        F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.greatest(*fits) if len(fits) > 1 else fits[0]


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: parts of the host, the first word of the path, the ending, query keys; few, as sets of them are mined."""
    labels = F.filter(F.split(host, r"[.-]"), lambda x: x != "")
    first = F.regexp_extract(F.lower(path), r"^/([\p{L}_-]+)", 1)
    ending = F.regexp_extract(F.lower(path), r"\.([a-z]{2,5})$", 1)
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1))
    named = lambda kind, x: F.when(x != "", F.concat(F.lit(kind), x))
    return F.array_distinct(F.array_compact(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)), F.array(named("path=", first), named("ending=", ending)),
        F.transform(keys, lambda x: F.concat(F.lit("key="), x)))))


def mine(labelled: DataFrame, path: str, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Pruned rules (tokens, verdict, confidence, support) from rows (tokens, verdict)."""
    spark = labelled.sparkSession
    labelled = write_table(labelled.select("tokens", "verdict"), f"{path}/labelled")
    empty = spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    n = labelled.count()
    if not n:
        return write_table(empty, f"{path}/rules")
    # Tokens under the support cannot be part of a frequent set; they and those of nearly all pages leave before the sets are built.
    common = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().where((F.col("count") >= min_support * n) & (F.col("count") <= MAX_SUPPORT * n))
    common = write_table(common, f"{path}/tokens")  # at most (tokens a page) / min_support rows
    kept = labelled.withColumn("id", F.monotonically_increasing_id())
    kept = write_table(kept, f"{path}/numbered")
    baskets = kept.select("id", F.explode("tokens").alias("token")).join(F.broadcast(common), "token", "left_semi").groupBy("id").agg(F.collect_set("token").alias("tokens"))
    baskets = kept.select("id", "verdict").join(baskets, "id", "left").select(
        F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(F.concat(F.lit(VERDICT), F.col("verdict")))).alias("items"))
    baskets = baskets.groupBy("items").count().select(F.explode(F.array_repeat("items", F.col("count").cast("int"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where(F.get("consequent", F.lit(0)).startswith(VERDICT) & (F.size("antecedent") <= MAX_TOKENS))
    rules = found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.get("consequent", F.lit(0)), len(VERDICT) + 1, 10).alias("verdict"), "confidence", "support")
    rules = write_table(rules, f"{path}/found")
    # A rule falls when a rule over part of its tokens gives the same verdict at least as surely.
    parts = rules.select("tokens", "verdict", "confidence", F.explode(_parts(F.col("tokens"))).alias("part"))
    plainer = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("plain"))
    beaten = parts.join(plainer, ["part", "verdict"]).where("plain >= confidence").select("tokens", "verdict").distinct()
    return write_table(rules.join(beaten, ["tokens", "verdict"], "left_anti"), f"{path}/rules")


def _parts(tokens: Column) -> Column:
    """All proper, non-empty subsets of up to three tokens."""
    one = F.transform(tokens, lambda x: F.array(x))
    two = F.flatten(F.transform(tokens, lambda x: F.transform(F.filter(tokens, lambda y: y > x), lambda y: F.array(x, y))))
    return F.filter(F.concat(one, two), lambda p: F.size(p) < F.size(tokens))


def matched(pages: DataFrame, rules: DataFrame, path: str) -> DataFrame:
    """For rows (row, tokens), the best mined rule: (row, mined, tokens of the rule, confidence)."""
    rarity = rules.select(F.explode("tokens").alias("token")).distinct()
    pages = pages.select("row", "tokens")
    counts = write_table(pages.select(F.explode("tokens").alias("token")).join(rarity, "token", "left_semi").groupBy("token").count(), f"{path}/rarity")
    filed = rules.withColumn("key", F.explode("tokens")).join(counts.withColumnRenamed("token", "key"), "key")
    filed = filed.groupBy("tokens", "verdict", "confidence").agg(F.min(F.struct("count", "key"))["key"].alias("key"))
    index = write_table(filed.select("key", F.col("tokens").alias("needs"), F.col("verdict").alias("mined"), "confidence"), f"{path}/index")
    hits = pages.select("row", "tokens", F.explode("tokens").alias("key")).join(index, "key").where(F.size(F.array_except("needs", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.size("needs").alias("n"), (F.col("mined") == "block").alias("b"), F.array_join("needs", " ").alias("needs"), "mined"))
    return hits.groupBy("row").agg(best.alias("best")).select("row", "best.mined", "best.needs", "best.confidence")


def judged(spark: SparkSession, pages: DataFrame, rules=RULES, id: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, mined_rule, confidence."""
    root = work_folder(spark)
    p = only(pages, page_id=id, url=url)
    host, path = host_and_path(F.col("url"))
    p = p.select("page_id", "url", host.alias("host"), path.alias("path"))
    p = p.withColumn("fit", explicit(F.col("host"), F.col("path"), rules)).withColumn("tokens", F.when(F.col("host") != "", tokens(F.col("url"), F.col("host"), F.col("path"))))
    p = p.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), "tokens", F.monotonically_increasing_id().alias("row"))
    p = write_table(p, f"{root}/pages")
    mined = mine(p.where("rule IS NOT NULL"), root)
    best = write_table(matched(p.where("rule IS NULL AND tokens IS NOT NULL"), mined, root), f"{root}/best")
    out = p.join(best.hint("merge"), "row", "left")  # grows with the pages, so it is never broadcast
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "mined", F.lit("allow")).alias("verdict"), F.col("needs").alias("mined_rule"), "confidence")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "mined_rule")


QUERIES = {"op5_url_filter": op5_url_filter}
SQL = {}
