"""Golden rows for the derivation, exposure and lookup checks."""

import pytest

from crosswitness.plans.checks import CHECKS, DERIVATIONS, Check, register_check, run_checks
from crosswitness.plans.facts import OVERALL_RESPONSE
from conftest import rows

TR_DDL = "USUBJID string, VISITNUM double, TRLNKID string, TRTESTCD string, TRSTRESN double, TRTARGETLN boolean, EPOCH string"
RS_DDL = "USUBJID string, VISITNUM double, RSSEQ double, RSCAT string, RSTESTCD string, RSORRES string, RSSTRESN double, RSDTC string"
TU_DDL = "USUBJID string, VISITNUM double, TULNKID string, TUCAT string"


@pytest.fixture()
def golden(make_study):
    sizes = {"A": [(30, 20), (15, 10), (0, 0)], "B": [(40,), (35,), (38,)], "C": [(50,), (30,), (35,)]}
    answers = {"A": [("NA", None), ("PR", "2025-02-01"), ("CR", "2025-03-15")], "B": [("NA", None), ("SD", None), ("PD", None)],
               "C": [("NA", None), ("PR", "2025-01-15"), ("SD", "2025-03-01")]}
    tr, rs, seq = [], [], 0
    for who, visits in sizes.items():
        for v, (values, (answer, day)) in enumerate(zip(visits, answers[who]), 1):
            for n, d in enumerate(values, 1):
                tr.append((f"SUBJ-{who}", float(v), f"T0{n}", "LDIAM", float(d), True, "SCREENING" if v == 1 else None))
            seq += 2
            rs.append((f"SUBJ-{who}", float(v), float(seq), "TARGET RESPONSE", "SUMDIAM", None, float(sum(values)), None))
            rs.append((f"SUBJ-{who}", float(v), float(seq + 1), "TARGET RESPONSE", "OVRESP", answer, None, day))
    tu = [("SUBJ-B", 1.0, "T01", "TARGET LESION"), ("SUBJ-B", 1.0, "T02", "TARGET LESION"), ("SUBJ-B", 3.0, "T03", "TARGET LESION")]
    return make_study(TR=(TR_DDL, tr), RS=(RS_DDL, rs), TU=(TU_DDL, tu))


def test_derivation_fixture_gives_exactly_three_flags(golden):
    flags = rows(run_checks(golden, DERIVATIONS), "rule_id", "subject", "visit", "severity")
    assert flags == [("S3", "SUBJ-C", "3.0", "violation"), ("S7", "SUBJ-A", "3.0", "warning"), ("S7", "SUBJ-C", "2.0", "warning")]


def test_one_check_alone_equals_the_check_in_a_group(golden):
    together = rows(run_checks(golden, DERIVATIONS), "rule_id", "record_id")
    alone = sorted(r for i in DERIVATIONS for r in rows(run_checks(golden, [i]), "rule_id", "record_id"))
    assert together == alone


def test_evidence_names_the_cells_of_the_check(golden):
    flag = [r for r in run_checks(golden, DERIVATIONS).collect() if r.rule_id == "S3"][0]
    assert {(e.type, e.value) for e in flag.evidence} == {("RSORRES", "SD"), ("SLD", "35.0"), ("BASE", "50.0")}


def test_added_disagreements_fire(golden, spark):
    rs = golden.raw("RS")
    wrong_sum = rs.filter("RSTESTCD = 'SUMDIAM' AND USUBJID = 'SUBJ-A' AND VISITNUM = 2").selectExpr(
        "USUBJID", "VISITNUM", "99D AS RSSEQ", "RSCAT", "RSTESTCD", "RSORRES", "26D AS RSSTRESN", "RSDTC")
    unread = rs.filter("RSTESTCD = 'OVRESP' AND USUBJID = 'SUBJ-A' AND VISITNUM = 3").selectExpr(
        "USUBJID", "4D AS VISITNUM", "98D AS RSSEQ", "RSCAT", "RSTESTCD", "'SD' AS RSORRES", "RSSTRESN", "RSDTC")
    changed = golden.with_tables(RS=rs.unionByName(wrong_sum).unionByName(unread))
    flags = rows(run_checks(changed, ["S1", "S8"]), "rule_id", "record_id")
    assert flags == [("S1", "RS/SUBJ-A/99"), ("S8", "RS/SUBJ-A/98")]


@pytest.mark.parametrize("onset, rel, starts, fires", [
    ("2020-01-03", "PROBABLE", ["2020-01-20", "2020-02-20"], True),
    ("2020-01-10", "PROBABLE", ["2020-01-01", "2020-02-01", "2020-03-01"], False),
    ("2020-01-03", "NONE", ["2020-01-20"], False),
    ("2020-01-15", "POSSIBLE", ["2020-01-20"], False),
    ("2020-01-25", "PROBABLE", ["2020-02-02"], True),
    ("2020-01-28", "PROBABLE", ["2020-02-02"], False),
    ("2020-01", "PROBABLE", ["2020-02-02"], False),
])
def test_event_before_first_exposure(make_study, onset, rel, starts, fires):
    st = make_study(AE=("USUBJID string, AESEQ double, AESTDTC string, AEREL string", [("S", 1.0, onset, rel)]),
                    EX=("USUBJID string, EXSEQ double, EXSTDTC string", [("S", float(n), d) for n, d in enumerate(starts, 1)]))
    assert rows(run_checks(st, ["A03"]), "record_id") == ([("EX/S/1",)] if fires else [])


@pytest.mark.parametrize("grain", ["subject", "record"])
@pytest.mark.parametrize("overall, nontarget, newlec, fires", [
    ("CR", "NON-CR/NON-PD", "N", True), ("CR", "CR", "N", False), ("SD", "PD", "N", True), ("CR", "CR", "Y", True), ("PD", "PD", "N", False)])
def test_lookup(make_study, grain, overall, nontarget, newlec, fires):
    rs = [("S", 1.0, 1.0, "OVERALL RESPONSE", "OVRLRESP", overall, None, None), ("S", 1.0, 2.0, "OVERALL RESPONSE", "NTOVRLRESP", nontarget, None, None),
          ("S", 1.0, 3.0, "OVERALL RESPONSE", "NEWLEC", newlec, None, None)]
    st = make_study(RS=(RS_DDL, rs))
    assert run_checks(st, ["A19"], lookup_grain=grain).count() == int(fires)


def test_lookup_falls_back_to_lesion_text(make_study):
    rs = [("S", 1.0, 1.0, "", "OVRLRESP", "CR", None, None), ("S", 1.0, 2.0, "", "NTOVRLRESP", "CR", None, None)]
    tu = ("USUBJID string, VISITNUM double, TULNKID string, TUTESTCD string", [("S", 2.0, "T9", "NewLesion")])
    assert run_checks(make_study(RS=(RS_DDL, rs)), ["A19"], "subject").count() == 0
    flag = run_checks(make_study(RS=(RS_DDL, rs), TU=tu), ["A19"], "subject").collect()[0]
    assert {e.type: e.value for e in flag.evidence}["expected_overall"] == "PD"


def test_lookup_table_size():
    assert len(OVERALL_RESPONSE) == 34
    assert ("PD", "CR", "NO") not in OVERALL_RESPONSE and ("SD", "PD", "YES") not in OVERALL_RESPONSE


def test_previous_visit_blocks_a01_even_without_a_value(make_study):
    tr = [("S", 1.0, "T1", "LDIAM", 50.0, True, None), ("S", 2.0, "T1", "LDIAM", None, True, None), ("S", 3.0, "T1", "LDIAM", 10.0, True, None)]
    rs = [("S", 3.0, 1.0, "", "OVRLRESP", "PD", None, None)]
    assert run_checks(make_study(TR=(TR_DDL, tr), RS=(RS_DDL, rs)), ["A01"]).count() == 0
    assert run_checks(make_study(TR=(TR_DDL, [tr[0], tr[2]]), RS=(RS_DDL, rs)), ["A01"]).count() == 1


def test_blank_cells_follow_the_check(make_study):
    ddl = "STUDYID string, USUBJID string, ARMCD string, ACTARMCD string, RFXSTDTC string, DTHFL string"
    st = make_study(DM=(ddl, [("1", "a", "", "", "", "Y"), ("1", "b", None, None, None, None), ("1", "c", "X", "X", "2020-01-01", "N"), ("1", "d", "Scrnfail", "Scrnfail", None, "y")]))
    assert rows(run_checks(st, ["A08", "A09", "A10", "A12", "A14"]), "rule_id", "subject") == [("A08", "c"), ("A09", "c"), ("A10", "c"), ("A12", "a"), ("A14", "c")]


def test_missing_tables_and_columns_read_as_no_value(make_study):
    st = make_study(DM=("USUBJID string, STUDYID string", [("a", "1"), ("a", "2"), ("b", "1")]))
    assert rows(run_checks(st), "rule_id", "subject") == [("A16", "a"), ("A16", "a")]


def test_exposed_without_arm_and_late_consent(make_study):
    st = make_study(DM=("USUBJID string, ARMCD string, ACTARMCD string, RFICDTC string", [("a", "", None, "2020-02-01"), ("b", "X", "X", "2019-01-01")]),
                    EX=("USUBJID string, EXSEQ double, EXSTDTC string", [("a", 1.0, "2020-01-01"), ("b", 1.0, "2020-01-01")]))
    assert rows(run_checks(st, ["H02", "H05"]), "rule_id", "subject") == [("H02", "a"), ("H05", "a")]


def test_user_checks_can_be_registered(make_study):
    from pyspark.sql import functions as F
    register_check(Check("X1", "DM", "Age above 120", lambda: F.col("AGE") > 120))
    try:
        st = make_study(DM=("USUBJID string, AGE double", [("a", 130.0), ("b", 50.0)]))
        assert rows(run_checks(st, ["X1"]), "subject") == [("a",)]
    finally:
        CHECKS.pop("X1")


def test_written_flags_equal_the_query(golden, tmp_path):
    from crosswitness.plans.checks import write_flags
    got = write_flags(golden, str(tmp_path / "flags"), DERIVATIONS)
    assert rows(got, "rule_id", "record_id") == rows(run_checks(golden, DERIVATIONS), "rule_id", "record_id")


def test_validate_joins_rules_checks_log_and_counts(golden, tmp_path, spark):
    from crosswitness.plans.rules import single_table_rules
    from crosswitness.plans.validate import IDENTITY, validate

    result = validate(golden)
    every = {tuple(r) for df in (single_table_rules(golden), run_checks(golden)) for r in df.select(*IDENTITY).collect()}
    got = [tuple(r) for r in result.flags.select(*IDENTITY).collect()]
    assert len(got) == len(set(got)) and set(got) == every
    assert sum(r.flags for r in result.counts.collect()) == len(got)
    path = str(tmp_path / "log")
    assert result.log(path, "one", "2025-01-01 00:00:00").count() == 0
    n = spark.read.parquet(path).count()
    result.log(path, "one", "2025-01-01 00:00:00")  # a repeated run replaces itself
    assert spark.read.parquet(path).count() == n


def test_write_flags_returns_its_own_groups_only(golden, tmp_path):
    from crosswitness.plans.checks import write_flags

    path = str(tmp_path / "flags")
    write_flags(golden, path, ("S1", "S4", "A01"))
    assert sorted(map(str, write_flags(golden, path, ("S4",)).collect())) == sorted(map(str, run_checks(golden, ("S4",)).collect()))
