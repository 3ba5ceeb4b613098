"""Set algebra and agreement metrics over flags."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswitness.operators.ordered import numbered
from crosswitness.sources.staging import required_root

PAIR = ("subject", "rule_id")
#: Draws in one block of a resampling.
DRAWS = 10_000


def union_flags(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def pairs(flags: DataFrame, on: tuple[str, ...] = PAIR) -> DataFrame:
    return flags.select(*on).distinct()


def only_in(a: DataFrame, b: DataFrame, on: tuple[str, ...] = PAIR) -> DataFrame:
    """Flags of ``a`` whose pair does not occur in ``b``."""
    return a.join(pairs(b, on), list(on), "left_anti")


def _sides(a: DataFrame, b: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """One row per pair with its presence on both sides (duplicates collapse map-side)."""
    tagged = a.select(*on, F.lit(True).alias("_a"), F.lit(False).alias("_b")).unionAll(
        b.select(*on, F.lit(False), F.lit(True)))
    return tagged.groupBy(*on).agg(F.bool_or("_a").alias("_a"), F.bool_or("_b").alias("_b"))


def ratio_or(numerator: Column, denominator: Column, empty: float) -> Column:
    return F.when(denominator == 0, F.lit(empty)).otherwise(numerator / denominator)


def jaccard(a: DataFrame, b: DataFrame, on: tuple[str, ...] = PAIR) -> DataFrame:
    """Sizes, overlap and Jaccard of two flag sets; two empty sets agree fully."""
    return _sides(a, b, on).agg(
        F.count_if("_a").alias("left_pairs"), F.count_if("_b").alias("right_pairs"),
        F.count_if(F.col("_a") & F.col("_b")).alias("overlap"), F.count(F.lit(1)).alias("union_pairs"),
    ).withColumn("jaccard", ratio_or(F.col("overlap"), F.col("union_pairs"), 1.0))


def jaccard_matrix(flags: DataFrame, sources: list[str], on: tuple[str, ...] = PAIR) -> DataFrame:
    """Jaccard of every two named sources in one pass over the flags.

    Each pair is reduced to one presence bit per source, so nothing is joined and no
    combinations of rows are formed.
    """
    seen = flags.groupBy(*on).agg(*[F.bool_or(F.col("source") == s).alias(f"_s{i}") for i, s in enumerate(sources)])
    cells, counts = [], []
    for i, left in enumerate(sources):
        for j, right in enumerate(sources):
            a, b = F.col(f"_s{i}"), F.col(f"_s{j}")
            counts += [F.count_if(a & b).alias(f"_i{i}_{j}"), F.count_if(a | b).alias(f"_u{i}_{j}")]
            cells.append(F.struct(F.lit(left).alias("left_source"), F.lit(right).alias("right_source"),
                                  F.col(f"_i{i}_{j}").alias("overlap"), F.col(f"_u{i}_{j}").alias("union_pairs")))
    return (seen.agg(*counts).select(F.inline(F.array(*cells)))
            .withColumn("jaccard", ratio_or(F.col("overlap"), F.col("union_pairs"), 1.0)))


def recall_by_rule(predicted: DataFrame, gold: DataFrame, on: tuple[str, ...] = PAIR) -> DataFrame:
    """Share of gold pairs recovered, per rule."""
    return (_sides(predicted, gold, on).filter("_b").groupBy("rule_id")
            .agg(F.count(F.lit(1)).alias("gold_pairs"), F.count_if("_a").alias("found"))
            .withColumn("recall", F.col("found") / F.col("gold_pairs")))


def regression_report(l1: DataFrame, gold: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Flag counts, overlap and Jaccard against a gold engine, with the pass mark.

    Both sides are tagged and counted in one pass, so each input is read once.
    """
    tagged = l1.select(*PAIR, F.lit(1).alias("_l"), F.lit(0).alias("_g")).unionAll(gold.select(*PAIR, F.lit(0), F.lit(1)))
    per_pair = tagged.groupBy(*PAIR).agg(F.sum("_l").alias("_l"), F.sum("_g").alias("_g"))
    return per_pair.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("l1_flags"), F.coalesce(F.sum("_g"), F.lit(0)).alias("core_flags"),
        F.count_if((F.col("_l") > 0) & (F.col("_g") > 0)).alias("overlap"), F.count(F.lit(1)).alias("_union"),
    ).withColumn("_j", ratio_or(F.col("overlap"), F.col("_union"), 1.0)).select(
        F.lit("A").alias("track"), F.round("_j", 4).alias("jaccard"), "l1_flags", "core_flags", "overlap",
        (F.col("_j") >= threshold).alias("pass_threshold"))


def novelty_report(ours: DataFrame, gold: DataFrame) -> DataFrame:
    """How many of our flags the other engine does not raise."""
    tagged = ours.select(*PAIR, F.lit(1).alias("_l"), F.lit(0).alias("_g")).unionAll(gold.select(*PAIR, F.lit(0), F.lit(1)))
    per_pair = tagged.groupBy(*PAIR).agg(F.sum("_l").alias("_l"), F.sum("_g").alias("_g"))
    return per_pair.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("our_flags"), F.coalesce(F.sum("_g"), F.lit(0)).alias("core_flags"),
        F.coalesce(F.sum(F.when(F.col("_g") == 0, F.col("_l"))), F.lit(0)).alias("only_ours"),
    ).select(F.lit("B").alias("track"), "our_flags", "core_flags", "only_ours", (F.col("only_ours") > 0).alias("has_novelty"))


def summary(flags: DataFrame, *by: str) -> DataFrame:
    """Flag rows and distinct subjects per group."""
    return flags.groupBy(*by).agg(F.count(F.lit(1)).alias("flags"), F.countDistinct("subject").alias("subjects"))


def subject_sketches(flags: DataFrame, *by: str) -> DataFrame:
    """One mergeable sketch of the flagged subjects per group; a few kilobytes however many there are."""
    return flags.groupBy(*by).agg(F.count(F.lit(1)).alias("flags"), F.hll_sketch_agg("subject", 14).alias("sketch"))


def merged_sketches(parts: DataFrame, *by: str) -> DataFrame:
    """Sketches of several runs or cohorts, stored earlier, as if their flags had been counted together."""
    return parts.groupBy(*by).agg(F.sum("flags").alias("flags"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    """``subjects`` from the sketches, within about 2% (three standard errors)."""
    return sketches.withColumn("subjects", F.hll_sketch_estimate("sketch")).drop("sketch")


def family(rule: Column) -> Column:
    """Bucket of a rule id: derivation, archetype, structural or anonymous."""
    return (F.when(rule.isNull() | (rule == ""), "anonymous").when(rule.rlike("^(DERIVATION|S[0-9])"), "derivation")
            .when(rule.rlike("^A[0-9]{2}$"), "archetype").otherwise("structural"))


# -- statistics over detection tables --------------------------------------------------

def _stirling_rest(x: Column) -> Column:
    """ln(x!) less Stirling's leading terms, for x >= 1."""
    exact = F.log(F.factorial(F.least(x, F.lit(20.0)).cast("int"))) - 0.5 * F.log(2 * math.pi * x) - x * F.log(x) + x
    return F.when(x <= 20, exact).otherwise(1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x))


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X <= k) of n fair tosses, for 2 * k <= n, in at most about 6 * sqrt(n) steps.

    The term of k comes in saddle-point form, which has no large numbers to cancel.  The terms below
    follow from it by their ratios; they fall at least as fast as exp(-2 j^2 / n), so those left
    out do not reach double precision.
    """
    k, n = k.cast("double"), n.cast("double")
    rest = n - k
    lean = (rest - k) / n
    deviance = k * F.log1p(-lean) + rest * F.log1p(lean)
    inner = -deviance + 0.5 * F.log(n / (2 * math.pi * k * rest)) + _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(rest)
    top = F.when(k == 0, -n * math.log(2.0)).otherwise(inner)
    steps = F.least(k, F.ceil(F.sqrt(20 * n)) + 50).cast("bigint")

    def step(acc: Column, j: Column) -> Column:
        t = acc["t"] * (k - j + 1) / (rest + j)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    below = F.when(steps < 1, 1.0).otherwise(F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(steps, F.lit(1))), start, step, lambda acc: acc["s"]))
    return F.exp(top) * below


def mcnemar(df: DataFrame, ours: Column, theirs: Column, by: list[str]) -> DataFrame:
    """Discordant counts and the exact two-sided p-value per group."""
    counts = df.groupBy(*by).agg(F.count_if(ours & ~theirs).alias("b"), F.count_if(~ours & theirs).alias("c"))
    n = F.col("b") + F.col("c")
    p = F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.least("b", "c"), n)))
    return counts.withColumn("p_value", F.round(F.round(p, 12), 6))  # the inner step absorbs noise at .5


def rate_interval(k: Column, n: Column, z: float = 1.96) -> Column:
    """Detection-rate interval by the Wilson form on n - 1 trials, closed at 0 and 1."""
    m = n - 1

    def bound(hits: Column, sign: float) -> Column:
        p = F.when(m > 0, hits / m).otherwise(0.0)
        size = F.greatest(m, F.lit(1))
        half = z * F.sqrt(F.greatest(p * (1 - p) / size + z * z / (4 * size * size), F.lit(0.0)))
        return (p + z * z / (2 * size) + sign * half) / (1 + z * z / size)

    low = F.when(k == 0, 0.0).otherwise(bound(k - 1, -1.0))
    high = F.when(k == n, 1.0).otherwise(bound(k, 1.0))
    return F.struct(F.round(low, 4).alias("low"), F.round(high, 4).alias("high"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> Column:
    precision, recall = ratio_or(tp, tp + fp, 0.0), ratio_or(tp, tp + fn, 0.0)
    f1 = ratio_or(2 * precision * recall, precision + recall, 0.0)
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def bootstrap_rate(items: DataFrame, hit: Column, reps: int = 1000, seed: int = 42) -> DataFrame:
    """95% bootstrap interval of a detection rate and its F1.

    Resampling yes/no items with replacement only depends on how many there are and how
    many are hits, so the items are counted first.  Every draw is a hash of (seed,
    repetition, position): any task can recompute any draw, and re-runs agree.  Repetitions are
    cut into blocks of draws, one row each, and blocks are counted where they are drawn.
    """
    n, k = items.agg(F.count(F.lit(1)), F.count_if(hit)).first()  # two numbers
    spark = items.sparkSession
    blocks = max(1, -(-n // DRAWS))
    pieces = spark.range(reps * blocks).select(F.expr(f"id div {blocks}").alias("rep"), (F.col("id") % blocks * DRAWS).alias("_at"))
    pieces = pieces.filter(F.col("_at") < n) if n else pieces.filter(F.lit(False))
    draws = pieces.select("rep", F.explode(F.sequence(F.col("_at") + 1, F.least(F.col("_at") + DRAWS, F.lit(n)))).alias("i"))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), "rep", "i")), 1, 8), 16, 10).cast("double") / float(2 ** 32)
    rates = draws.groupBy("rep").agg((F.count_if(u * n < k) / F.lit(n)).alias("rate"))
    ranked = numbered(rates, [], [F.col("rate").asc()], "_r", f"{required_root(spark)}/rates")
    at = {name: F.max(F.when(F.col("_r") == place, F.col("rate"))) for name, place in (("low", int(reps * 0.025) + 1), ("high", int(reps * 0.975)))}
    f1 = lambda rate: F.when(rate > 0, 2 * rate / (1 + rate)).when(rate.isNotNull(), 0.0)  # rises with the rate, so the ranks are the same
    out = ranked.agg(*[v.alias(name) for name, v in at.items()])
    return out.select(F.lit(reps).alias("reps"), F.round("low", 4).alias("rate_low"), F.round("high", 4).alias("rate_high"),
                      F.round(f1(F.col("low")), 4).alias("f1_low"), F.round(f1(F.col("high")), 4).alias("f1_high"))


def fleiss_kappa(ratings: DataFrame, categories: list[str]) -> DataFrame:
    """Agreement of a fixed number of raters over items, from per-item category counts."""
    raters = sum((F.col(c) for c in categories), F.lit(0))
    per = ratings.select(*categories, raters.alias("_r"))
    agree = (sum((F.col(c) * F.col(c) for c in categories), F.lit(0)) - F.col("_r")) / (F.col("_r") * (F.col("_r") - 1))
    sums = per.agg(
        F.count(F.lit(1)).alias("items"), F.max("_r").alias("raters"), F.sum(agree).alias("_pi"),
        *[F.sum(c).alias(f"_n_{c}") for c in categories],
        F.count_if(F.col(categories[0]) == F.col("_r")).alias("unanimous_valid"),
        F.count_if(F.col(categories[0]) > F.col("_r") / 2).alias("majority_valid"),
        F.count_if(F.col(categories[1]) > 0).alias("any_invalid"),
        F.count_if(F.col(categories[2]) > F.col("_r") / 2).alias("majority_uncertain"))
    chance = sum((F.pow(F.col(f"_n_{c}") / (F.col("items") * F.col("raters")), 2) for c in categories), F.lit(0.0))
    kappa = F.when(chance == 1.0, 1.0).otherwise((F.col("_pi") / F.col("items") - chance) / (1 - chance))
    return sums.select("items", "raters", F.round(kappa, 4).alias("kappa"), "unanimous_valid", "majority_valid",
                       "any_invalid", "majority_uncertain")


def kappa_label(kappa: Column) -> Column:
    """Conventional wording for an agreement value."""
    return (F.when(kappa < 0.0, "Poor").when(kappa < 0.21, "Slight").when(kappa < 0.41, "Fair")
            .when(kappa < 0.61, "Moderate").when(kappa < 0.81, "Substantial").otherwise("Almost perfect"))


def consensus(votes: DataFrame, item: str, verdict: str) -> DataFrame:
    """Most frequent verdict per item (smallest on ties) and its share; errors are ignored."""
    counted = votes.filter(F.col(verdict) != "error").groupBy(item, verdict).count()
    return counted.groupBy(item).agg(
        F.min_by(F.col(verdict), F.struct(-F.col("count"), F.col(verdict))).alias("consensus"),
        F.round(F.max("count") / F.sum("count"), 3).alias("agreement_rate"))


def detection_matrix(detections: DataFrame, sources: list[str]) -> DataFrame:
    """Archetype by engine, 1 where the engine detected it."""
    return (detections.groupBy("archetype").pivot("source", sources)
            .agg(F.max(F.col("detected").cast("int"))).na.fill(0, sources))


def adjudicate(new_issues: DataFrame, classification: DataFrame) -> DataFrame:
    """Whether an external engine's new issues express the injected contradiction.

    ``classification``: archetype, category, matched_rule, confidence (direct, indirect or
    none); one row per archetype.
    """
    fired = new_issues.groupBy("archetype").agg(F.count(F.lit(1)).alias("new_issues"))
    matched = (new_issues.join(classification.select("archetype", F.col("matched_rule").alias("rule_id")), ["archetype", "rule_id"], "left_semi")
               .select("archetype").distinct().withColumn("_fired", F.lit(True)))
    out = classification.join(fired, "archetype", "left").join(matched, "archetype", "left")
    hit = F.coalesce("_fired", F.lit(False))
    return out.select(
        "archetype", "category", F.coalesce("new_issues", F.lit(0)).alias("new_issues"),
        F.when(hit, F.col("confidence")).otherwise("none").alias("detection_confidence"),
        (hit & (F.col("confidence") == "direct")).alias("direct"), (hit & (F.col("confidence") == "indirect")).alias("indirect"))


def adjudication_summary(adjudicated: DataFrame) -> DataFrame:
    return adjudicated.groupBy("category").agg(
        F.count(F.lit(1)).alias("archetypes"), F.count_if(F.col("new_issues") > 0).alias("flagged"),
        F.count_if("direct").alias("direct"), F.count_if("indirect").alias("indirect"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that differ between two versions of a table, with their multiplicity.

    Copies are counted map-side first, so a heavily repeated row costs one shuffled record.
    """
    names = before.columns
    both = before.select(*names, F.lit(-1).alias("_d")).unionAll(after.select(*names, F.lit(1)))
    return both.groupBy(*names).agg(F.sum("_d").alias("difference")).filter(F.col("difference") != 0)
