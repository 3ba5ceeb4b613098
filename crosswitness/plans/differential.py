"""Inject-and-detect without copying the study: only what an injection changes exists twice.

Every check but A17 looks at one subject, so one contradiction can be injected into all
subjects of one virtual study at once: each subject is its own scenario.  Archetypes are taken
one after the other, in a job per group of checks, whose result is a count per subject and check.
Only the tables that an archetype changes are made again, and only checks that read one of them
run again.  The flags of all other checks are those of the unchanged study, which is checked
once.  In a study that lies by subject (``Study.buckets``) none of this shuffles a table.

A17 compares subjects of an arm.  Its scenarios are judged by correcting the arm's names: the
peer's own names are taken back from the arm's counts and the conflicting name is added.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswitness.operators.skew import keyed_join
from crosswitness.plans import facts as fx
from crosswitness.plans.checks import ARCHETYPES, CHECKS, check_groups, flag_counts, one_scan, reads, run_checks
from crosswitness.plans.detect import by_archetype, candidates, recall_on_applicable
from crosswitness.plans.enrich import enrich_responses
from crosswitness.plans.inject import TOUCHES, drop_fraction, fractional_visits, inject, orphan_keys
from crosswitness.sources.staging import removed, staging_root, written, written_by_subject
from crosswitness.sources.study import Study

#: Checks that look at one subject only.
LOCAL = tuple(a for a in ARCHETYPES if a != "A17")
CONFLICT = "CONFLICTING ARM NAME"


def affected(archetype: str, checks: tuple[str, ...] = LOCAL) -> tuple[str, ...]:
    """Checks that read a table the injection changes."""
    return tuple(c for c in checks if reads(c).intersection(TOUCHES[archetype]))


def _label(check: str) -> str:
    return check if check[0] in "AH" else f"DERIVATION-{check}"


def clean_counts(study: Study, checks: tuple[str, ...]) -> DataFrame:
    """Flags per subject and archetype of the unchanged study, counted once for all who ask."""
    root = staging_root(study.spark)
    return flag_counts(study, checks, root and f"{root}/before")


@dataclass(frozen=True)
class Experiment:
    """Scenarios tried (injected, USUBJID), and flag counts per subject and archetype before and after."""

    tried: DataFrame
    before: DataFrame
    after: DataFrame
    checks: tuple[str, ...]

    def newly_flagged(self) -> DataFrame:
        return self.after.join(self.before, ["subject", "archetype"], "left_anti")

    def deltas(self, archetypes: tuple[str, ...]) -> DataFrame:
        """(injected, flag_delta): flags after minus flags before, over all scenarios of an archetype."""
        spark = self.tried.sparkSession
        rows = [(a, _label(c)) for a in archetypes for c in affected(a, self.checks)]
        pairs = F.broadcast(spark.createDataFrame(rows, "injected string, archetype string"))  # bounded by the lists of checks
        before = (self.before.join(pairs, "archetype").join(self.tried.withColumnRenamed("USUBJID", "subject"), ["injected", "subject"], "left_semi")
                  .select("injected", (-F.col("flags")).alias("n")))
        every = self.tried.select("injected", F.lit(0).cast("bigint").alias("n"))
        return (self.after.select("injected", F.col("flags").alias("n")).unionByName(before).unionByName(every)
                .groupBy("injected").agg(F.sum("n").alias("flag_delta")))


#: So many groups of checks have to read a changed table that lies by subject before it is written for them.
LOOKS_IN_PLACE = 3


def lasting_facts(runs: dict[str, tuple[str, ...]]) -> list[str]:
    """Facts about subjects that the checks of several archetypes look up and whose tables these leave alone."""
    looked_up = Counter(f for a, ids in runs.items() for f in {f for c in ids if c in CHECKS for f in CHECKS[c].facts}
                        if not set(fx.FACT_TABLES[f]).intersection(TOUCHES[a]) and "USUBJID" in fx.FACTS[f][0])
    return sorted(f for f, n in looked_up.items() if n > 1)


def experiment(study: Study, plan: DataFrame, archetypes: tuple[str, ...], checks: tuple[str, ...] = LOCAL,
               own_only: bool = False, before: DataFrame | None = None) -> Experiment:
    """Inject every archetype of the plan (archetype, USUBJID) into its subjects and check what can change.

    ``own_only`` runs of each archetype only the check of its own name.
    """
    study = study if study.loads else study.measured()
    root = staging_root(study.spark)
    keep = lambda df, path: written_by_subject(df, path, study.buckets) if study.buckets else written(df, path)
    plan = keep(plan, root and f"{root}/plan")
    tried_by = by_archetype(plan, archetypes, lambda df: keep(df, root and f"{root}/plan-by-subject"))
    if before is None:
        before = clean_counts(study, checks)
    runs = {a: ids for a in archetypes if (ids := tuple(c for c in (a[-3:],) if c in checks) if own_only else affected(a, checks))}
    base = fx.with_facts(study, lasting_facts(runs), lambda df, name: keep(df, f"{root}/facts/{name}")) if root else study
    parts = []
    for a, ids in runs.items():
        who = tried_by(a)
        changed, _ = inject(base, a, who)
        # A table that several groups of checks read is made once for them; where the tables lie by subject, another look costs no shuffle.
        groups = check_groups(ids)
        readers = {d: sum(any(d in reads(c) for c in g) for g in groups) for d in TOUCHES[a] if study.raw(d) is not None}
        made = {d: keep(changed.raw(d), root and f"{root}/changed-{a}/{d}") for d, n in readers.items() if n >= (LOOKS_IN_PLACE if study.buckets else 1)}
        parts.append(flag_counts(changed.with_tables(**made) if made else changed, ids, root and f"{root}/after-{a}",
                                 who.withColumnRenamed("USUBJID", "subject"), injected=a))
        if made and root:
            removed(study.spark, f"{root}/changed-{a}")
    after = one_scan(parts, root and [f"{root}/after-{a}/{'-'.join(g)}" for a, ids in runs.items() for g in check_groups(ids)])
    return Experiment(plan.select(F.col("archetype").alias("injected"), "USUBJID"), before, after, checks)


def arm_scenarios(study: Study, subjects: DataFrame) -> DataFrame:
    """A17 injected into each subject on its own: (USUBJID, flag_delta, hit).

    The peer of a subject is the lowest other one of its arm, so an arm has at most two peers,
    and each peer is judged once: names of its arms, less its own rows, plus the new name.
    """
    dm = study["DM"].filter(F.col("ARMCD").isNotNull())
    load = study.load("DM by ARMCD")
    lowest = dm.groupBy("ARMCD").agg(F.min("USUBJID").alias("_p1"))
    others = keyed_join(dm.select("ARMCD", "USUBJID"), lowest, ["ARMCD"], "inner", load).filter(F.col("USUBJID") != F.col("_p1"))
    peers = lowest.join(others.groupBy("ARMCD").agg(F.min("USUBJID").alias("_p2")), "ARMCD", "left")
    first = dm.join(subjects.select("USUBJID").distinct(), "USUBJID", "left_semi").groupBy("USUBJID").agg(F.min_by("ARMCD", "STUDYID").alias("ARMCD"))
    mine = keyed_join(first, peers, ["ARMCD"], "inner", load).select(
        "USUBJID", F.when(F.col("_p1") != F.col("USUBJID"), F.col("_p1")).otherwise(F.coalesce("_p2", "USUBJID")).alias("peer"))
    # Rows of a peer, by arm and name, against the names of the arm.
    who = mine.select(F.col("peer").alias("USUBJID")).distinct()
    own = dm.join(who, "USUBJID", "left_semi").groupBy("USUBJID", "ARMCD", "ARM").agg(F.count(F.lit(1)).alias("_own"))
    names = dm.groupBy("ARMCD", "ARM").agg(F.count(F.lit(1)).alias("_rows"))
    arms = own.groupBy("USUBJID", "ARMCD").agg(F.sum("_own").alias("_changed"))
    per = arms.join(names, "ARMCD").join(own.select("USUBJID", "ARMCD", F.col("ARM").alias("_name"), "_own"),
                                         (F.col("_name").eqNullSafe(F.col("ARM"))) & (arms["USUBJID"] == own["USUBJID"]) & (arms["ARMCD"] == own["ARMCD"]), "left").select(
        arms["USUBJID"].alias("peer"), arms["ARMCD"], "ARM", "_rows", F.coalesce("_own", F.lit(0)).alias("_own"), "_changed")
    left = F.col("_rows") - F.col("_own")
    named = F.col("ARM").isNotNull()
    verdict = per.groupBy("peer", "ARMCD").agg(
        (F.min("ARM") != F.max("ARM")).alias("_was"), F.coalesce(F.bool_or(named & (left > 0) & (F.col("ARM") != CONFLICT)), F.lit(False)).alias("_is"),
        F.sum(F.when(named, F.col("_rows")).otherwise(0)).alias("_n_was"),
        (F.sum(F.when(named, left).otherwise(0)) + F.max("_changed")).alias("_n_is"))
    was, now = F.coalesce("_was", F.lit(False)), F.col("_is")
    effect = verdict.groupBy("peer").agg(
        F.sum(F.when(now, F.col("_n_is")).otherwise(0) - F.when(was, F.col("_n_was")).otherwise(0)).alias("flag_delta"),
        F.bool_or(now & ~was).alias("hit"))
    return keyed_join(mine, effect, ["peer"], "inner").select("USUBJID", "flag_delta", "hit")


def lookup_hits(study: Study) -> tuple[DataFrame, DataFrame]:
    """A19 with its derived rows added after the injection: subjects tried, and those newly flagged."""
    root = staging_root(study.spark)
    keep = lambda df, name: (written_by_subject(df, root and f"{root}/{name}", study.buckets) if study.buckets else written(df, root and f"{root}/{name}"))
    bare = study.with_tables(RS=study["RS"].filter(~F.coalesce(F.col("RSTESTCD").isin("NTOVRLRESP", "NEWLEC"), F.lit(False))))
    # Subjects, and the table with its changes, are made in jobs of their own: else one task held the sorts of all steps that use them.
    plan = keep(candidates(bare, run_checks(enrich_responses(bare), ("A19",), "subject"), ("A19",)).select("USUBJID"), "lookup-plan")
    changed, _ = inject(bare, "A19", plan)
    changed = changed.with_tables(RS=keep(changed.raw("RS"), "lookup-changed"))
    flagged = run_checks(enrich_responses(changed), ("A19",), "subject").select(F.col("subject").alias("USUBJID")).distinct()
    hits = written(flagged.join(plan, "USUBJID", "left_semi"), root and f"{root}/lookup-hits")
    removed(study.spark, root and f"{root}/lookup-changed")
    return plan, hits


def _counts(archetype, tried: DataFrame, hits: DataFrame) -> DataFrame:
    done = tried.join(hits.withColumn("_hit", F.lit(True)), "USUBJID", "left")
    return done.agg(F.count(F.lit(1)).alias("candidates_tried"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("candidates_detected"),
                    F.min(F.when(F.col("_hit"), F.col("USUBJID"))).alias("first_detected")).withColumn("archetype", F.lit(archetype))


def _with_status(df: DataFrame) -> DataFrame:
    return df.select("archetype", "candidates_tried", "candidates_detected", "first_detected", F.when(
        F.col("candidates_detected") > 0, "detected").when(F.col("candidates_tried") > 0, "missed").otherwise("no candidate").alias("status"))


def verdicts(study: Study, archetypes: tuple[str, ...] = LOCAL, found: Experiment | None = None) -> DataFrame:
    """Per archetype: candidates tried, candidates whose own check newly fires, the first of them, and the verdict."""
    if found is None:
        before = clean_counts(study, tuple(dict.fromkeys(a[-3:] for a in archetypes)))
        named = before.select(F.col("subject").alias("USUBJID"), F.col("archetype").alias("_check")).distinct()
        every = study["DM"].select("USUBJID").distinct().withColumn("archetype", F.explode(F.array(*[F.lit(a) for a in archetypes])))
        plan = every.withColumn("_check", F.substring("archetype", -3, 3)).join(named, ["USUBJID", "_check"], "left_anti").select("archetype", "USUBJID")
        found = experiment(study, plan, archetypes, tuple(dict.fromkeys(a[-3:] for a in archetypes)), own_only=True, before=before)
    hits = (found.newly_flagged().filter(F.col("archetype") == F.substring("injected", -3, 3))
            .select("injected", F.col("subject").alias("USUBJID")).distinct().withColumn("_hit", F.lit(True)))
    done = found.tried.join(hits, ["injected", "USUBJID"], "left").groupBy(F.col("injected").alias("archetype")).agg(
        F.count(F.lit(1)).alias("candidates_tried"), F.count_if(F.coalesce("_hit", F.lit(False))).alias("candidates_detected"),
        F.min(F.when(F.col("_hit"), F.col("USUBJID"))).alias("first_detected"))
    every = study.spark.createDataFrame([(a,) for a in archetypes], "archetype string")
    return _with_status(every.join(done, "archetype", "left").na.fill(0, ["candidates_tried", "candidates_detected"]))


def all_verdicts(study: Study) -> DataFrame:
    """The twenty archetypes: A17 on its arm, A19 with derived rows, the others by their own check."""
    alone = tuple(a for a in LOCAL if a != "A19")
    root = staging_root(study.spark)
    free = written(candidates(study, run_checks(study, ("A17",)), ("A17",)).select("USUBJID"), root and f"{root}/arm-plan")
    arm = _counts("A17", free, written(arm_scenarios(study, free).filter("hit").select("USUBJID"), root and f"{root}/arm-hits"))
    lookup = _counts("A19", *lookup_hits(study))
    return verdicts(study, alone).unionByName(_with_status(arm)).unionByName(_with_status(lookup))


def flag_deltas(study: Study) -> DataFrame:
    """Per archetype: change of the number of flags over all candidates, each injected on its own."""
    before = clean_counts(study, ARCHETYPES)
    plan = candidates(study, before, ARCHETYPES)
    local = experiment(study, plan.filter("archetype <> 'A17'"), LOCAL, before=before).deltas(LOCAL)
    # A17 changes one name in DM, so no other check but the arm's own can answer.
    free = plan.filter("archetype = 'A17'").select("USUBJID")
    arm = arm_scenarios(study, free).agg(F.coalesce(F.sum("flag_delta"), F.lit(0)).alias("flag_delta")).withColumn("injected", F.lit("A17"))
    return local.unionByName(arm).select(F.col("injected").alias("archetype"), "flag_delta", (F.col("flag_delta") != 0).alias("detected"))


def single_pass(study: Study) -> DataFrame:
    """Without a clean reference: does the archetype's own check flag an injected subject, and how many clean ones?"""
    clean = clean_counts(study, ARCHETYPES)
    plan = candidates(study, clean, ARCHETYPES)
    found = experiment(study, plan.filter("archetype <> 'A17'"), LOCAL, own_only=True, before=clean)
    fired = found.after.filter(F.col("archetype") == F.col("injected")).select("injected", "subject")
    free = plan.filter("archetype = 'A17'").select("USUBJID")
    arm = arm_scenarios(study, free).filter("hit").select(F.lit("A17").alias("injected"), F.col("USUBJID").alias("subject"))
    fired = fired.unionByName(arm).groupBy(F.col("injected").alias("archetype")).agg(F.lit(True).alias("_hit"))
    noise = clean.groupBy("archetype").agg(F.countDistinct("subject").alias("clean_fp_subjects"))
    return (plan.select("archetype").distinct().join(fired, "archetype", "left").join(noise, "archetype", "left")
            .select("archetype", F.coalesce("_hit", F.lit(False)).alias("detected"), F.coalesce("clean_fp_subjects", F.lit(0)).alias("clean_fp_subjects")))


def held_out(study: Study, archetypes: tuple[str, ...], subjects: DataFrame) -> DataFrame:
    """Held-out contradictions: any check that newly fires on the injected subject, against the naive flag delta."""
    plan = subjects.select("USUBJID").distinct().withColumn("archetype", F.explode(F.array(*[F.lit(a) for a in archetypes])))
    found = experiment(study, plan, archetypes)
    new = found.newly_flagged().groupBy("injected").agg(
        F.countDistinct("subject").alias("subjects_with_new_flags"), F.array_join(F.array_sort(F.collect_set("archetype")), ",").alias("new_checks"))
    tried = found.tried.groupBy("injected").agg(F.count(F.lit(1)).alias("candidates_tried"))
    return tried.join(new, "injected", "left").join(found.deltas(archetypes), "injected").select(
        F.col("injected").alias("archetype"), "candidates_tried", F.coalesce("subjects_with_new_flags", F.lit(0)).alias("subjects_with_new_flags"),
        F.coalesce("new_checks", F.lit("")).alias("new_checks"), "flag_delta", (F.coalesce("subjects_with_new_flags", F.lit(0)) > 0).alias("detected"))


def recall(study: Study) -> DataFrame:
    return recall_on_applicable(study, all_verdicts(study))


def robustness(study: Study, checks: tuple[str, ...] = ARCHETYPES, seed: int = 42,
               levels: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5), share: float = 0.15) -> DataFrame:
    """Flag counts under missing rows, broken links and undefined visits: a job per group of checks, keyed by (perturbation, level).

    A run's TR, RS and TU are read from the study's own, whose rows are left out or changed as they are
    read; no run's tables are written.  Checks that read none of them are counted once for all.
    """
    study = study if study.loads else study.measured()
    seen: dict = {}
    runs = [("missing", 0.0, study)] + [("missing", float(p), drop_fraction(study, p, seed, seen=seen)) for p in levels if p > 0]
    broken = orphan_keys(study, share, seed, seen)
    root = staging_root(study.spark)
    if study.buckets:  # the added response does not lie with the others
        broken = broken.with_tables(RS=written_by_subject(broken.raw("RS"), root and f"{root}/broken/RS", study.buckets))
    runs += [("orphan_links", share, broken), ("fractional_visits", share, fractional_visits(study, share, seed, seen))]
    changed = [d for d in ("TR", "RS", "TU") if study.raw(d) is not None]
    some = tuple(c for c in checks if reads(c).intersection(changed))
    rest = tuple(c for c in checks if c not in some)
    count = [F.count_if(F.col("archetype").startswith("A")).alias("n"), F.count_if(F.col("archetype") == "A04").alias("a04_flags")]

    def counted(wheres: list[tuple[str, Study]], ids: tuple[str, ...], name: str) -> DataFrame:
        """One job per group of checks, as in :func:`flag_counts`; a run's flags are counted in stages of their own."""
        parts = []
        for g in check_groups(ids):
            one = [run_checks(s, g).agg(*count).select(F.lit(key).alias("scenario_id"), "n", "a04_flags") for key, s in wheres]
            parts.append(written(reduce(lambda x, y: x.unionByName(y), one), root and f"{root}/{name}/{'-'.join(g)}"))
        return reduce(lambda x, y: x.unionByName(y), parts).groupBy("scenario_id").agg(F.sum("n").alias("n"), F.sum("a04_flags").alias("a04_flags"))

    found = counted([(f"{n}/{p}", s) for n, p, s in runs], some, "perturbed-flags")
    always = (counted([("any", study)], rest, "other-flags").select(F.col("n").alias("_rest")) if rest else study.spark.range(1).select(F.lit(0).alias("_rest")))
    every = study.spark.createDataFrame([(f"{n}/{p}", n, p) for n, p, _ in runs], "scenario_id string, perturbation string, level double")
    curve = every.join(found, "scenario_id", "left").na.fill(0, ["n", "a04_flags"]).join(F.broadcast(always.withColumn("_k", F.lit(1))), F.lit(True)).select(
        "perturbation", "level", (F.col("n") + F.col("_rest")).alias("archetype_flags"), "a04_flags")
    curve = written(curve, root and f"{root}/curve")
    clean = curve.filter("perturbation = 'missing' AND level = 0").select(F.col("archetype_flags").alias("_clean"))
    return curve.join(F.broadcast(clean), F.lit(True)).select(
        "perturbation", "level", "archetype_flags", "a04_flags", (F.col("archetype_flags") - F.col("_clean")).alias("delta_vs_clean"))


def stability(curve: DataFrame) -> DataFrame:
    """One row about a robustness run: the largest increase under missing rows, and what undefined visits do to A04 and to the rest.

    The run is stable when missing rows and undefined visits raise no archetype flags beyond A04's own.
    """
    missing = F.col("perturbation") == "missing"
    clean, moved = missing & (F.col("level") == 0), F.col("perturbation") == "fractional_visits"
    other = F.col("archetype_flags") - F.col("a04_flags")
    at = lambda where, value: F.max(F.when(where, value))
    out = curve.agg(
        F.max(F.when(missing, F.col("delta_vs_clean"))).alias("missing_max_increase"),
        at(F.col("perturbation") == "orphan_links", F.col("delta_vs_clean")).alias("orphan_delta"),
        (at(moved, F.col("a04_flags")) > at(clean, F.col("a04_flags"))).alias("undefined_visits_caught"),
        (at(moved, other) - at(clean, other)).alias("undefined_visits_other_delta"))
    return out.withColumn("stable", (F.col("missing_max_increase") <= 0) & (F.col("undefined_visits_other_delta") <= 0))
