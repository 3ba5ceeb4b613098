import random

import pytest
from pyspark.sql import functions as F

from crosswitness.plans import detect, enrich, integrity
from crosswitness.plans import inject as ij
from crosswitness.plans.checks import run_checks
from crosswitness.sources.study import Study
from conftest import rows

DM = "STUDYID string, USUBJID string, SEX string, RACE string, ARMCD string, ARM string, ACTARMCD string, DTHFL string, RFSTDTC string, RFXSTDTC string, RFXENDTC string, RFICDTC string"
RS = "USUBJID string, VISITNUM double, RSSEQ double, RSCAT string, RSTESTCD string, RSORRES string, RSSTRESC string, RSDTC string"
TR = "USUBJID string, VISITNUM double, TRSEQ double, TRLNKID string, TRGRPID string, TRTESTCD string, TRSTRESN double, TRORRES string"


@pytest.fixture(scope="module")
def trial(spark, tmp_path_factory):
    """Four consistent subjects, staged once."""
    make_study = lambda **tables: Study(spark, {d: spark.createDataFrame(r, ddl).coalesce(1) for d, (ddl, r) in tables.items()}).staged(
        str(tmp_path_factory.mktemp("trial")))
    who = ["s1", "s2", "s3", "s4"]
    day = ["2020-01-01", "2020-02-01", "2020-03-01"]
    answers = ["SD", "PR", "PR"]
    sizes = [(40.0, 60.0), (30.0, 55.0), (25.0, 30.0)]
    return make_study(
        DM=(DM, [("ST", s, "F", "WHITE", "A", "Arm A", "A", None, day[0], day[0], day[2], "2019-12-01") for s in who]),
        TA=("ARMCD string, ARM string", [("A", "Arm A")]),
        EX=("USUBJID string, EXSEQ double, EXSTDTC string, EXENDTC string", [(s, float(n + 1), d, d) for s in who for n, d in enumerate(day)]),
        AE=("USUBJID string, AESEQ double, AESTDTC string, AEREL string", [(s, 1.0, "2020-01-10", "Y") for s in who]),
        DS=("USUBJID string, DSSEQ double, DSDECOD string", [(s, 1.0, "COMPLETED") for s in who]),
        SUPPDM=("USUBJID string, QNAM string, QVAL string", [("s1", "SEX", "F")]),
        TU=("USUBJID string, VISITNUM double, TUSEQ double, TULNKID string, TUCAT string",
            [(s, 0.0, float(n), f"T{n:02d}", "TARGET LESION") for s in who for n in (1, 2)] + [(s, 0.0, 3.0, "NT01", "NON-TARGET LESION") for s in who]),
        TR=(TR, [(s, float(v + 1), float(v * 3 + n), f"T{n:02d}", "TARGET", "LDIAM", sizes[v][n - 1], "") for s in who for v in range(3) for n in (1, 2)]
            + [(s, float(v + 1), float(v * 3 + 3), "NT01", "NON-TARGET", "TUMSTATE", None, "PRESENT") for s in who for v in range(3)]),
        RS=(RS, [(s, float(v + 1), float(v + 1), "OVERALL RESPONSE", "OVRLRESP", answers[v], answers[v], day[v]) for s in who for v in range(3)]),
        RELREC=("RDOMAIN string, USUBJID string, IDVAR string, IDVARVAL string, RELTYPE string, RELID string",
                [(d, s, f"{d}SEQ", "1", "ONE", f"{d}{s}") for d in ("EX", "DS", "AE") for s in who]),
    )


def one(spark, *who):
    return spark.createDataFrame([(w,) for w in who], "USUBJID string")


def test_clean_trial_is_silent(trial):
    assert rows(run_checks(trial), "rule_id", "subject") == []


@pytest.mark.parametrize("archetype", sorted(a for a in ij.INJECTIONS if a not in ("A07", "A19")))
def test_each_injection_is_found_on_its_subject(trial, spark, archetype):
    changed, manifest = ij.inject(trial, archetype, one(spark, "s2"))
    flags = run_checks(changed, [archetype])
    assert manifest.collect() == [("s2", archetype, ",".join(ij.TOUCHES[archetype]))]
    subjects = {r[0] for r in rows(flags, "subject")}
    if archetype == "A17":  # the peer is renamed, so the whole arm is in conflict
        assert "s1" in subjects and changed["DM"].filter("USUBJID = 's1'").first().ARM == "CONFLICTING ARM NAME"
    else:
        assert subjects == {"s2"}


def test_a07_removes_assessments_more_than_28_days_after_the_response(trial, spark):
    changed, _ = ij.inject(trial, "A07", one(spark, "s2"))
    assert rows(changed["RS"].filter("USUBJID = 's2'"), "VISITNUM") == [(1.0,), (2.0,)]  # PR on 1 Feb, next visit 1 March
    near = trial.with_tables(RS=trial.raw("RS").withColumn("RSDTC", F.when(F.col("VISITNUM") == 3, "2020-02-20").otherwise(F.col("RSDTC")))
                             .withColumn("RSORRES", F.when(F.col("VISITNUM") == 3, "SD").otherwise(F.col("RSORRES"))))
    changed, _ = ij.inject(near, "A07", one(spark, "s2"))
    assert ("s2", "2.0") in rows(run_checks(changed, ["A07"]), "subject", "visit")


def test_lookup_injection_after_enrichment(trial, spark):
    changed, _ = ij.inject(trial, "A19", one(spark, "s3"))
    flags = run_checks(enrich.enrich_responses(changed), ["A19"], "subject")
    assert rows(flags, "subject") == [("s3",)]
    assert run_checks(enrich.enrich_responses(trial), ["A19"], "subject").count() == 0


def test_deletions_leave_no_orphan_relations(trial, spark):
    for archetype in ("A09", "A14"):
        changed, _ = ij.inject(trial, archetype, one(spark, "s1", "s4"))
        assert integrity.orphan_relations(changed).count() == 0
        assert changed["RELREC"].count() == 10
    cut = ij.drop_relations(trial, "AE", one(spark, "s1"), "AESEQ", F.lit(2))
    assert cut["RELREC"].count() == 12
    assert ij.drop_relations(trial, "AE", one(spark, "s1"), "AESEQ", F.lit(1))["RELREC"].count() == 11


def test_variants(trial, spark):
    changed, _ = ij.inject(trial, "VA07", one(spark, "s1"))
    assert rows(run_checks(changed, ["A07"]), "subject", "visit") == [("s1", "1.0")]
    changed, _ = ij.inject(trial, "VA20", one(spark, "s1"))
    assert rows(run_checks(changed, ["A20"]), "subject", "visit") == [("s1", "4.0")]
    single = trial.with_tables(RS=trial.raw("RS").filter("VISITNUM = 1"))
    changed, _ = ij.inject(single, "VA07", one(spark, "s1"))
    assert sorted(changed["RS"].collect()) == sorted(single["RS"].collect())


def test_untouched_subjects_keep_every_row(trial, spark):
    keep = lambda st, d: sorted(map(str, st[d].filter("USUBJID <> 's2'").collect()))
    clean = {d: keep(trial, d) for d in ("RS", "TR", "TU", "EX", "SUPPDM")}
    for archetype in ("A01", "A02", "A03", "A05", "A07", "H04"):
        changed, _ = ij.inject(trial, archetype, one(spark, "s2"))
        for d in ij.TOUCHES[archetype]:
            assert keep(changed, d) == clean[d], (archetype, d)


def test_candidates_and_detection(trial):
    got = {r.archetype: r for r in detect.candidate_detection(trial, ("A01", "A08", "A14", "A16"), k=2).collect()}
    assert {a: (r.candidates_tried, r.candidates_detected, r.first_detected) for a, r in got.items()} == {
        "A01": (2, 2, "s1"), "A08": (2, 2, "s1"), "A14": (2, 2, "s1"), "A16": (2, 2, "s1")}


def test_brute_force_agrees_with_the_scenario_run(trial, spark):
    """Each scenario run on its own gives what the joint job gives."""
    names, checks = ("A04", "A06", "A09"), ("A04", "A06", "A09", "A18")
    scenarios, flags = detect.scenario_flags_of(trial, names, one(spark, "s1", "s3"), checks)
    joint = rows(detect.newly_flagged(flags), "injected", "subject", "archetype")
    alone = []
    for a in names:
        for s in ("s1", "s3"):
            mini = enrich.restrict(trial, one(spark, s))
            changed, _ = ij.inject(mini, a, one(spark, s))
            before = set(rows(run_checks(mini, checks), "subject", "archetype"))
            alone += [(a, *r) for r in set(rows(run_checks(changed, checks), "subject", "archetype")) - before]
    assert joint == sorted(alone)
    assert {r.archetype: r.flag_delta for r in detect.delta_detection(flags).collect()}["A09"] == 2


def test_copies_without_flags_are_counted(trial, spark):
    """A copy that lost all its flags, and an archetype none of whose copies is flagged, still have their rows."""
    scenarios, flags = detect.scenario_flags_of(trial, ("A08", "H02"), one(spark, "s1"))
    lost = spark.createDataFrame([("clean", "s1", "A05", 3)], flags.schema)
    assert {r.archetype: (r.flag_delta, r.detected) for r in detect.delta_detection(lost, scenarios).collect()} == {"A08": (-3, True), "H02": (-3, True)}
    assert {r.archetype: r.detected for r in detect.single_pass(lost, lost, scenarios).collect()} == {"A08": False, "H02": False}
    got = detect.summarise(scenarios, flags, ("A08", "A02")).collect()
    assert {r.archetype: (r.candidates_tried, r.status) for r in got} == {"A08": (1, "detected"), "A02": (0, "no candidate")}


def test_cohort_and_lookup_routes(trial):
    cohort, lookup = detect.by_cohort(trial, "A17").first(), detect.by_lookup(trial).first()
    assert (cohort.archetype, cohort.candidates_tried, cohort.status) == ("A17", 1, "detected")
    assert lookup.archetype == "A19" and lookup.status == "detected"


def test_held_out_and_single_pass(trial, spark):
    scenarios, flags = detect.scenario_flags_of(trial, ("H02", "H04", "H05"), one(spark, "s1"))
    got = {r.archetype: r for r in detect.held_out(scenarios, flags).collect()}
    assert not got["H02"].detected and got["H04"].detected and "A18" in got["H04"].new_checks and not got["H05"].detected
    _, flags = detect.scenario_flags_of(trial, ("A08",), one(spark, "s1"))
    assert detect.single_pass(flags, run_checks(trial)).first().detected


def test_cohort_and_recall(trial, spark):
    cohort = detect.cohort_detection(trial, "A17", one(spark, "s2")).first()
    assert (cohort.total_flag_delta, cohort.status) == (4, "detected")
    results = spark.createDataFrame([("A08", "detected"), ("A06", "missed"), ("A10", "missed")], "archetype string, status string")
    sparse = Study(spark, {d: df for d, df in trial.tables.items() if d not in ("EX", "AE")})
    got = detect.recall_on_applicable(sparse, results).first()
    assert (got.applicable, got.detected, got.recall, got.missed_ids) == (2, 1, 0.5, "A06")
    assert got.na_ids == "A03,A10,A11,A14,A15,A19"


def test_applicability_widens_with_the_data(trial, spark):
    assert [r[0] for r in rows(integrity.not_applicable(trial), "check_id")] == ["A19"]  # no derived response codes
    coded = trial.raw("RS").withColumn("RSTESTCD", F.explode(F.array(F.col("RSTESTCD"), F.lit("NTOVRLRESP"), F.lit("NEWLEC"))))
    assert integrity.not_applicable(trial.with_tables(RS=coded)).count() == 0
    bare = Study(spark, {"DM": trial.raw("DM").drop("ACTARMCD"), "RS": trial.raw("RS").drop("RSDTC"), "TR": trial.raw("TR")})
    assert [r[0] for r in rows(integrity.not_applicable(bare), "check_id")] == ["A03", "A07", "A09", "A10", "A11", "A14", "A15", "A19", "A20"]
    unrelated = trial.with_tables(AE=trial.raw("AE").withColumn("AEREL", F.lit("NONE")))
    assert rows(integrity.not_applicable(unrelated), "check_id", "reason") [:1] == [("A03", "adverse events carry no attribution")]


def test_compatible_set(spark):
    df = spark.createDataFrame([("s", a) for a in ("A01", "A06", "A08", "A20", "A12")], "USUBJID string, archetype string")
    assert rows(ij.compatible_set(df, ["USUBJID"]), "archetype") == [("A01",), ("A08",), ("A12",)]


def test_co_occurrence(trial, spark):
    plan = spark.createDataFrame([("s1", "A06"), ("s1", "A08"), ("s1", "A12")], "USUBJID string, archetype string")
    got = detect.co_occurrence(trial, plan, plan, ("A06", "A08", "A12")).first()
    assert (got.injected, got.jointly_detected, got.co_occurrence_recall) == (3, 3, 1.0)


def test_exact_fraction(spark, make_study):
    rnd = random.Random(1)
    data = [(f"s{n % 10}", float(n), rnd.random()) for n in range(100)]
    st = make_study(TR=("USUBJID string, VISITNUM double, TRSTRESN double", data), DM=("USUBJID string", [(f"s{n}",) for n in range(10)]))
    kept = ij.drop_fraction(st, 0.25, seed=3, domains=("TR",)).raw("TR")
    assert kept.count() == 75 and sorted(kept.collect()) == sorted(ij.drop_fraction(st, 0.25, seed=3, domains=("TR",)).raw("TR").collect())
    assert sorted(kept.collect()) != sorted(ij.drop_fraction(st, 0.25, seed=4, domains=("TR",)).raw("TR").collect())
    assert ij.drop_fraction(st, 0.0, seed=3).raw("TR").count() == 100
    copies = st.with_tables(TR=spark.createDataFrame([("s", 1.0, 1.0)] * 40 + data[:20], "USUBJID string, VISITNUM double, TRSTRESN double"))
    assert ij.drop_fraction(copies, 0.5, seed=1, domains=("TR",)).raw("TR").count() == 30
    who = enrich.pick_subjects(st, 4, seed=9)
    small = enrich.restrict(st, who)
    assert who.count() == 4 and set(rows(small.raw("TR"), "USUBJID")) <= set(rows(small.raw("DM"), "USUBJID"))


def test_orphans_and_fractional_visits(trial):
    broken = ij.orphan_keys(trial, 0.15, seed=1)
    assert broken.raw("TR").filter("TRLNKID = 'ORPHAN-LESION-ZZZ'").count() == 5
    assert integrity.orphan_lesions(broken).count() >= 5
    assert rows(integrity.unknown_subjects(broken), "USUBJID") == [("GHOST-SUBJECT-000",)]
    moved = ij.fractional_visits(trial, 0.15, seed=1)
    assert run_checks(moved, ["A04"]).count() == 1 == moved.raw("RS").filter("VISITNUM <> floor(VISITNUM)").count()


def test_replication(trial):
    three = enrich.replicate(trial, 3)
    assert three["DM"].select("USUBJID").distinct().count() == 12 and three["TA"].count() == 1
    assert "s1_R2" in {r[0] for r in rows(three["RS"], "USUBJID")}
    assert run_checks(three).count() == 0


def test_enrichment_skips_subjects_without_a_target_response(make_study):
    st = make_study(RS=(RS, [("a", 1.0, 1.0, "", "OVRLRESP", "NON-CR/NON-PD", "", None), ("b", 1.0, 4.0, "", "OVRLRESP", "sd", "", None)]),
                    TU=("USUBJID string, VISITNUM double, TULNKID string", [("b", 2.0, "New 1")]), TR=(TR, []))
    added = enrich.enrich_responses(st)["RS"].filter("RSTESTCD <> 'OVRLRESP'")
    assert rows(added, "USUBJID", "RSSEQ", "RSTESTCD", "RSORRES") == [("b", 5.0, "NTOVRLRESP", "NON-CR/NON-PD"), ("b", 6.0, "NEWLEC", "Y")]
    assert enrich.enrich_responses(st, blanket=True)["RS"].filter("RSORRES = 'N'").count() == 2
