"""Inject-and-detect experiments: every scenario is a tagged copy, all are checked in one job.

A scenario is one contradiction injected into one subject.  Its copy holds that subject's
rows (trial-design tables are shared), tagged with ``scenario_id``, which is part of every
key while the checks run.  Unchanged copies of the same subjects are checked alongside, so
a detection is a flag the unchanged copy does not have.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswitness.operators.skew import keyed_join, measure, pair_join
from crosswitness.plans.checks import ARCHETYPES, flag_counts, run_checks
from crosswitness.plans.enrich import enrich_responses
from crosswitness.plans.inject import ALL_INJECTIONS, TOUCHES, drop_fraction, fractional_visits, inject, orphan_keys
from crosswitness.plans.integrity import not_applicable
from crosswitness.sources.staging import removed, staging_root, written, written_by_subject
from crosswitness.sources.study import Deferred, Study

CLEAN = "clean"


def _root(study: Study) -> str | None:
    return staging_root(study.spark)


def candidates(study: Study, clean: DataFrame, archetypes: tuple[str, ...], k: int | None = None) -> DataFrame:
    """(archetype, USUBJID) to try: subjects not already flagged, lowest ids first, ``k`` each.

    ``k=None`` takes every such subject.  Each list is a distributed top-k.
    """
    subjects = study["DM"].select("USUBJID").distinct()
    flagged = clean.select("archetype", F.col("subject").alias("USUBJID")).distinct()
    # The list of archetypes is fixed and short, so the copies of the subjects are few.
    free = subjects.withColumn("archetype", F.explode(F.array(*[F.lit(a) for a in archetypes]))).join(flagged, ["archetype", "USUBJID"], "left_anti")
    if k is None:
        return free.select("archetype", "USUBJID")
    parts = [free.filter(F.col("archetype") == a).orderBy("USUBJID").limit(k) for a in archetypes]
    return reduce(lambda x, y: x.unionByName(y), parts).select("archetype", "USUBJID")


def by_archetype(plan: DataFrame, archetypes: tuple[str, ...], keep: Callable[[DataFrame], DataFrame]) -> Callable[[str], DataFrame]:
    """The subjects (USUBJID) of each archetype of the plan, from one kept table with a row per subject and a column per archetype."""
    wide = keep(plan.groupBy("USUBJID").agg(*[F.bool_or(F.col("archetype") == a).alias(a) for a in archetypes]))
    return lambda a: wide.filter(F.col(a)).select("USUBJID")


def scenario_study(study: Study, plan: DataFrame, archetypes: tuple[str, ...], enrich: bool = False) -> Study:
    """All injected copies, plus one unchanged copy per subject, as one study keyed by scenario."""
    root = _root(study)
    plan = written(plan, root and f"{root}/plan")
    clean = plan.select(F.lit(CLEAN).alias("archetype"), "USUBJID").distinct()
    tagged = plan.unionByName(clean).withColumn("scenario_id", F.concat_ws("/", "archetype", "USUBJID"))
    # The plan can repeat a subject, so neither side is unique.
    study = study if study.loads else study.measured()
    planned = measure({"plan": (tagged, ("USUBJID",))})["plan"]
    # A table is copied when an injection or a check reads it, so tables that none of them reads are never copied.
    def copied(domain: str) -> DataFrame:
        load = study.load(domain)
        copies = pair_join(study[domain], tagged.withColumnRenamed("archetype", "_archetype"), ["USUBJID"], loads=(load, planned) if load else None)
        return written(copies, root and f"{root}/copies/{domain}")

    base = Deferred({d: lambda d=d: copied(d) for d in study.tables if study.by_subject(d)})
    shared = {d: lambda d=d: study.tables[d] for d in study.tables if d not in base}
    keys = ("scenario_id", "USUBJID")
    changes: dict[str, dict[str, Study]] = {d: {} for d in base}
    for a in archetypes:
        mine = {d: lambda d=d, a=a: base[d].filter(F.col("_archetype") == a).drop("_archetype") for d in base}
        changed, _ = inject(Study(study.spark, Deferred({**mine, **shared}), keys), a, tagged.filter(F.col("archetype") == a).select("scenario_id", "USUBJID"))
        for d in TOUCHES[a]:
            if d in base:
                changes[d][a] = changed

    def merged(d: str) -> DataFrame:
        same = base[d].filter(~F.col("_archetype").isin(*changes[d])) if changes[d] else base[d]
        every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [same.drop("_archetype"), *[c[d] for c in changes[d].values()]])
        return written(every, root and f"{root}/scenarios/{d}") if changes[d] else every

    out = Study(study.spark, Deferred({**{d: lambda d=d: merged(d) for d in base}, **shared}), keys)
    return enrich_responses(out) if enrich else out


def scenario_flags(scenarios: Study, checks: tuple[str, ...] = ARCHETYPES, lookup_grain: str = "record") -> DataFrame:
    """Distinct (injected, subject, archetype flagged, flags) per scenario."""
    flags = run_checks(scenarios.measured_on_demand(), checks, lookup_grain)
    named = flags.withColumn("injected", F.substring_index("scenario_id", "/", 1))
    out = named.groupBy("injected", "subject", "archetype").agg(F.count(F.lit(1)).alias("flags"))
    root = _root(scenarios)
    return written(out, root and f"{root}/scenario-flags")


def newly_flagged(flags: DataFrame) -> DataFrame:
    """Flags of injected copies that the unchanged copy of the subject does not have."""
    clean = flags.filter(F.col("injected") == CLEAN).select("subject", "archetype")
    return flags.filter(F.col("injected") != CLEAN).join(clean, ["subject", "archetype"], "left_anti")


def candidate_detection(study: Study, archetypes: tuple[str, ...] = ARCHETYPES, k: int | None = None, enrich: bool = False) -> DataFrame:
    """Per archetype: candidates tried, candidates on which it newly fires, and the verdict.

    Only the archetypes in question are checked, since only they decide.
    """
    plan = candidates(study, run_checks(study, archetypes), archetypes, k)
    scenarios = scenario_study(study, plan, archetypes, enrich)
    flags = scenario_flags(scenarios, archetypes)
    return summarise(scenarios, flags, archetypes)


def tried(scenarios: Study) -> DataFrame:
    return (scenarios["DM"].select(F.substring_index("scenario_id", "/", 1).alias("injected"), "USUBJID").distinct()
            .filter(F.col("injected") != CLEAN))


def summarise(scenarios: Study, flags: DataFrame, archetypes: tuple[str, ...]) -> DataFrame:
    """One row per archetype; one for which no subject could be tried has the status "no candidate"."""
    hits = newly_flagged(flags).filter(F.col("archetype") == F.col("injected")).select("injected", F.col("subject").alias("USUBJID"), F.lit(True).alias("_hit"))
    done = (tried(scenarios).join(hits.distinct(), ["injected", "USUBJID"], "left").groupBy(F.col("injected").alias("archetype"))
            .agg(F.count(F.lit(1)).alias("candidates_tried"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("candidates_detected"),
                 F.min(F.when(F.col("_hit"), F.col("USUBJID"))).alias("first_detected")))
    every = scenarios.spark.createDataFrame([(a,) for a in archetypes], "archetype string")
    return every.join(done, "archetype", "left").na.fill(0, ["candidates_tried", "candidates_detected"]).withColumn(
        "status", F.when(F.col("candidates_detected") > 0, "detected").when(F.col("candidates_tried") > 0, "missed").otherwise("no candidate"))


def delta_detection(flags: DataFrame, scenarios: Study | None = None) -> DataFrame:
    """Change of the total number of flags against the unchanged copies, per injected archetype.

    With ``scenarios`` every copy that was tried counts, also one that lost all its flags or never had any.
    """
    totals = flags.groupBy("injected", "subject").agg(F.sum("flags").alias("n"))
    clean = totals.filter(F.col("injected") == CLEAN).select("subject", F.col("n").alias("_clean"))
    copies = totals.filter(F.col("injected") != CLEAN)
    if scenarios is not None:
        copies = tried(scenarios).withColumnRenamed("USUBJID", "subject").join(copies, ["injected", "subject"], "left")
    both = copies.join(clean, "subject", "left")
    delta = F.sum(F.coalesce("n", F.lit(0)) - F.coalesce("_clean", F.lit(0)))
    return both.groupBy(F.col("injected").alias("archetype")).agg(delta.alias("flag_delta")).withColumn("detected", F.col("flag_delta") != 0)


def single_pass(flags: DataFrame, clean: DataFrame, scenarios: Study | None = None) -> DataFrame:
    """Without a clean reference: is the injected subject flagged by its own archetype?

    ``clean_fp_subjects`` counts subjects the archetype flags on unchanged data.  With
    ``scenarios`` an archetype whose copies carry no flag at all is reported as not detected.
    """
    copies = flags.filter(F.col("injected") != CLEAN).select("injected", "archetype")
    if scenarios is not None:
        copies = tried(scenarios).select("injected").distinct().join(copies, "injected", "left")
    hit = copies.groupBy(F.col("injected").alias("archetype")).agg(
        F.coalesce(F.bool_or(F.col("archetype") == F.col("injected")), F.lit(False)).alias("detected"))
    noise = clean.filter(F.col("archetype").startswith("A")).groupBy("archetype").agg(F.countDistinct("subject").alias("clean_fp_subjects"))
    return hit.join(noise, "archetype", "left").na.fill(0, ["clean_fp_subjects"])


def held_out(scenarios: Study, flags: DataFrame) -> DataFrame:
    """Held-out contradictions: any check that newly fires on the injected subject, against the naive flag delta."""
    new = newly_flagged(flags).groupBy(F.col("injected").alias("archetype")).agg(
        F.countDistinct("subject").alias("subjects_with_new_flags"), F.array_sort(F.collect_set("archetype")).alias("new_checks"))
    every = tried(scenarios).groupBy(F.col("injected").alias("archetype")).agg(F.count(F.lit(1)).alias("candidates_tried"))
    naive = delta_detection(flags, scenarios).select("archetype", F.col("flag_delta"))
    return every.join(new, "archetype", "left").join(naive, "archetype", "left").select(
        "archetype", "candidates_tried", F.coalesce("subjects_with_new_flags", F.lit(0)).alias("subjects_with_new_flags"),
        F.array_join(F.coalesce("new_checks", F.array().cast("array<string>")), ",").alias("new_checks"),
        F.coalesce("flag_delta", F.lit(0)).alias("flag_delta"), (F.coalesce("subjects_with_new_flags", F.lit(0)) > 0).alias("detected"))


def cohort_detection(study: Study, archetype: str, subject: DataFrame, checks: tuple[str, ...] | None = None) -> DataFrame:
    """Injection judged on the whole cohort, for contradictions between subjects."""
    checks = checks or (archetype,)
    changed, _ = inject(study, archetype, subject)
    before = run_checks(study, checks).select(F.lit(0).alias("_after"), "archetype", "subject")
    after = run_checks(changed, checks).select(F.lit(1).alias("_after"), "archetype", "subject")
    pairs = before.unionByName(after).groupBy("archetype", "subject").agg(
        F.count_if(F.col("_after") == 0).alias("_b"), F.count_if(F.col("_after") == 1).alias("_a"))
    return pairs.agg(
        (F.sum("_a") - F.sum("_b")).alias("total_flag_delta"),
        F.count_if((F.col("archetype") == archetype) & (F.col("_a") > 0) & (F.col("_b") == 0)).alias("newly_flagged_subjects"),
    ).select(F.lit(archetype).alias("archetype"), "total_flag_delta", "newly_flagged_subjects",
             F.when(F.col("newly_flagged_subjects") > 0, "detected").otherwise("missed").alias("status"))


def by_cohort(study: Study, archetype: str) -> DataFrame:
    """A row of :func:`summarise` for a contradiction between subjects: one injection, judged on the whole cohort."""
    one = candidates(study, run_checks(study, (archetype,)), (archetype,), 1).select("USUBJID")
    judged = cohort_detection(study, archetype, one).withColumn("_hit", F.col("status") == "detected")
    first = one.agg(F.count(F.lit(1)).alias("candidates_tried"), F.min("USUBJID").alias("_who")).withColumn("archetype", F.lit(archetype))
    return first.join(judged, "archetype").select(
        "archetype", "candidates_tried", F.when(F.col("_hit"), F.col("candidates_tried")).otherwise(F.lit(0)).cast("bigint").alias("candidates_detected"),
        F.when(F.col("_hit"), F.col("_who")).alias("first_detected"), F.when(F.col("candidates_tried") == 0, "no candidate").otherwise(F.col("status")).alias("status"))


def by_lookup(study: Study, archetype: str = "A19") -> DataFrame:
    """A row of :func:`summarise` for the lookup: the derived response rows are added after the injection, to both copies."""
    bare = study.with_tables(RS=study["RS"].filter(~F.coalesce(F.col("RSTESTCD").isin("NTOVRLRESP", "NEWLEC"), F.lit(False))))
    plan = candidates(bare, run_checks(enrich_responses(bare), (archetype,), "subject"), (archetype,))
    scenarios = scenario_study(bare, plan, (archetype,), enrich=True)
    return summarise(scenarios, scenario_flags(scenarios, (archetype,), "subject"), (archetype,))


def recall_on_applicable(study: Study, results: DataFrame) -> DataFrame:
    """Detected, missed and not-applicable archetypes, and recall over the applicable ones.

    An archetype without a candidate was not judged and does not count.
    """
    na = not_applicable(study).select(F.col("check_id").alias("archetype"), F.lit(True).alias("_na"))
    status = results.select("archetype", "status").join(na, "archetype", "full_outer").withColumn(
        "_s", F.when(F.col("_na"), "na").otherwise(F.col("status")))
    one = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("_s") == s, F.col("archetype")))), ",")  # at most one entry per archetype
    return status.agg(
        F.count_if(F.col("_s").isin("detected", "missed")).alias("applicable"), F.count_if(F.col("_s") == "detected").alias("detected"),
        one("detected").alias("detected_ids"), one("missed").alias("missed_ids"), one("na").alias("na_ids"),
    ).withColumn("recall", F.when(F.col("applicable") > 0, F.col("detected") / F.col("applicable")))


def robustness(study: Study, checks: tuple[str, ...] = ARCHETYPES, seed: int = 42,
               levels: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5), share: float = 0.15) -> DataFrame:
    """Flag counts under missing rows, broken links and undefined visits, against the clean count."""
    runs: list[tuple[str, float, Study]] = [("missing", p, drop_fraction(study, p, seed)) for p in levels]
    runs += [("orphan_links", share, orphan_keys(study, share, seed)), ("fractional_visits", share, fractional_visits(study, share, seed))]
    root = _root(study)
    counted = []
    for n, (name, level, changed) in enumerate(runs):
        if root:
            changed = changed.with_tables(**{d: written(changed.raw(d), f"{root}/perturbed/{n}/{d}") for d in ("TR", "RS", "TU") if changed.raw(d) is not None})
        flags = run_checks(changed, checks)
        counted.append(flags.agg(
            F.count_if(F.col("archetype").startswith("A")).alias("archetype_flags"), F.count_if(F.col("archetype") == "A04").alias("a04_flags"),
        ).select(F.lit(name).alias("perturbation"), F.lit(float(level)).alias("level"), "archetype_flags", "a04_flags"))
    curve = reduce(lambda x, y: x.unionByName(y), counted)
    clean = curve.filter("perturbation = 'missing' AND level = 0").select(F.lit(1).alias("_k"), F.col("archetype_flags").alias("_clean"))
    return curve.withColumn("_k", F.lit(1)).join(clean, "_k").select(
        "perturbation", "level", "archetype_flags", "a04_flags", (F.col("archetype_flags") - F.col("_clean")).alias("delta_vs_clean"))


def co_occurrence(study: Study, plan: DataFrame, singles: DataFrame, archetypes: tuple[str, ...]) -> DataFrame:
    """All compatible contradictions injected into one copy per subject: which still fire together?

    ``plan``: USUBJID, archetype to inject together; ``singles``: pairs that fire alone.  Only the checks
    of ``archetypes`` run, since no other one is asked for.
    """
    root = _root(study)
    study = study if study.loads else study.measured()
    keep = lambda df, path: written_by_subject(df, path, study.buckets) if study.buckets else written(df, path)
    plan = keep(plan, root and f"{root}/joint-plan")
    flagged = lambda s, name: flag_counts(s, archetypes, root and f"{root}/{name}").select(F.col("subject").alias("USUBJID"), "archetype")
    tried_by = by_archetype(plan, archetypes, lambda df: keep(df, root and f"{root}/joint-plan-by-subject"))
    subjects = keep(plan.select("USUBJID").distinct(), root and f"{root}/joint-subjects")
    current = study.with_tables(**{
        d: (keyed_join(df, subjects, ["USUBJID"], "left_semi", study.load(d)) if "USUBJID" in df.columns else df) for d, df in study.tables.items()})
    clean = flagged(current, "joint-before")
    last: dict[str, str] = {}
    for n, a in enumerate(archetypes):
        current, _ = inject(current, a, tried_by(a))
        if root:
            made = {d: f"{root}/joint/{n}/{d}" for d in TOUCHES[a] if current.raw(d) is not None}
            current = current.with_tables(**{d: keep(current.raw(d), path) for d, path in made.items()})
            for d in made:  # the table as an earlier injection left it
                removed(study.spark, last.get(d))
            last.update(made)
    fired = flagged(current, "joint-after")
    new = fired.join(clean, ["USUBJID", "archetype"], "left_anti").withColumn("_hit", F.lit(True))
    return (plan.join(singles, ["USUBJID", "archetype"], "left_semi").join(new, ["USUBJID", "archetype"], "left").groupBy("USUBJID")
            .agg(F.count(F.lit(1)).alias("injected"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("jointly_detected"))
            .filter("injected >= 2").withColumn("co_occurrence_recall", F.round(F.col("jointly_detected") / F.col("injected"), 3)))


def scenario_flags_of(study: Study, archetypes: tuple[str, ...], subjects: DataFrame,
                      checks: tuple[str, ...] = ARCHETYPES) -> tuple[Study, DataFrame]:
    """Inject every named archetype into every given subject and check all copies."""
    unknown = [a for a in archetypes if a not in ALL_INJECTIONS]
    if unknown:
        raise ValueError(f"no injection for {unknown}")
    plan = subjects.select("USUBJID").distinct().withColumn("archetype", F.explode(F.array(*[F.lit(a) for a in archetypes])))
    scenarios = scenario_study(study, plan.select("archetype", "USUBJID"), archetypes)
    return scenarios, scenario_flags(scenarios, checks)
