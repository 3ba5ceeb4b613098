import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosswitness.functions import scalars as sc
from crosswitness.plans import enrich, integrity, mapping
from crosswitness.sources import inventory, issues, sinks
from crosswitness.sources.study import Study, load_study
from conftest import rows


@pytest.fixture(scope="module")
def lesion_form(spark):
    les = "PT string, VISITNUM double, LESID string, LNGDIA double, DIASUM double, LESSIT string, LESEVL string, NDONE string"
    raw = {
        "lesles": spark.createDataFrame([("1", 0.0, "T01", 30.0, None, "LIVER", "", ""), ("1", 0.0, "NT01", None, None, "LUNG", "PRESENT", ""),
                                         ("1", 1.0, "T01", 20.0, None, "LIVER", "", ""), ("1", 1.0, "T02", None, None, "LUNG", "", "not done"),
                                         ("1", 0.0, " ", None, 31.0, "", "", ""), ("x", 0.0, "T01", 9.0, None, "", "", "")], les),
        "rsp": spark.createDataFrame([("1", 0.0, " ", None, "SD"), ("1", 1.0, "PR", "NE", " PR ")], "PT string, VISITNUM double, TRSP string, NTRSP string, ORSP string"),
        "dm": spark.createDataFrame([("1", 50.0, "F", "WHITE", "Drug plus X"), ("1", 50.0, "F", "WHITE", "Drug plus X"), ("x", 60.0, None, None, None)],
                                    "PT string, AGE double, SEX string, RACE string, TRTP string"),
        "ds": spark.createDataFrame([("1", "COMPLETED", None, "END"), ("x", " ", None, None)], "PT string, DSDECOD string, DSCAT string, EPOCH string"),
    }
    return mapping.map_lesion_form(raw, mapping.TrialConfig("ST"))


def test_lesion_form(lesion_form):
    assert rows(lesion_form["TU"], "USUBJID", "TULNKID", "VISITNUM", "TUSEQ", "TUCAT") == [
        ("ST-1", "NT01", 0.0, 1.0, "NON-TARGET LESION"), ("ST-1", "T01", 0.0, 2.0, "TARGET LESION"), ("ST-1", "T02", 1.0, 3.0, "TARGET LESION"),
        ("ST-x", "T01", 0.0, 1.0, "TARGET LESION")]
    tr = {(r.USUBJID, r.VISITNUM, r.TRLNKID): r for r in lesion_form["TR"].collect()}
    assert tr[("ST-1", 1.0, "T02")].TRSTAT == "NOT DONE" and tr[("ST-1", 1.0, "T02")].TRSTRESN is None
    assert tr[("ST-1", 0.0, "NT01")].TRTESTCD == "TUMSTATE" and tr[("ST-1", 0.0, "T01")].EPOCH == "SCREENING" and tr[("ST-1", 0.0, "T01")].TRTARGETLN
    sums = rows(lesion_form["RS"].filter("RSTESTCD = 'SUMDIAM'"), "USUBJID", "VISITNUM", "RSSTRESN")
    assert sums == [("ST-1", 0.0, 31.0), ("ST-1", 1.0, 20.0), ("ST-x", 0.0, 9.0)]  # reported first, computed otherwise
    assert rows(lesion_form["RS"].filter("RSTESTCD <> 'SUMDIAM'"), "VISITNUM", "RSTESTCD", "RSORRES") == [
        (0.0, "OVRLRESP", "SD"), (1.0, "NTRGRESP", "NE"), (1.0, "OVRESP", "PR"), (1.0, "OVRLRESP", "PR")]
    assert rows(lesion_form["DM"], "USUBJID", "ARM", "ARMCD") == [("ST-1", "Drug plus X", "DRUGPLU"), ("ST-x", "", "")]
    assert rows(lesion_form["TA"], "ARMCD", "ETCD", "TASEQ") == [("DRUGPLU", "EL01", 1.0)]
    assert rows(lesion_form["DS"], "USUBJID", "DSDECOD", "DSSEQ") == [("ST-1", "COMPLETED", 1.0)]


def test_mapped_study_is_whole(lesion_form):
    assert integrity.orphan_lesions(lesion_form).count() == 0
    assert integrity.unknown_subjects(lesion_form).count() == 0
    assert integrity.off_list_codes(lesion_form).count() == 0
    assert integrity.sum_match_rate(lesion_form).first().rate == 1.0


def test_visit_form(spark):
    n = lambda *v: [tuple(v)]
    raw = {
        "lesions": spark.createDataFrame([(7.0, 1.0, "Target", 1.0, "LIVER", 12.0, "", 0.0), (7.0, 2.0, "target lesion", 1.0, "LIVER", None, "", 40.0),
                                          (7.0, 1.0, "Non-target", 2.0, "BONE", None, "Cannot be seen clearly", None), (7.0, 1.0, "Target", None, "", 3.0, "", 0.0)],
                                         "RSUBJ_ID double, VISIT_ID double, LESTYPE string, LESNUM double, LESLOC string, TGTSIZE double, QUAN string, EXAMDAY double"),
        "responses": spark.createDataFrame([(7.0, 1.0, 0.0, "{---}", "nd", "sd", 12.0)], "RSUBJ_ID double, VISIT_ID double, EXAMDAY double, TGTRESP string, NTGTRESP string, ALLRESP string, SUMTGT double"),
        "demo": spark.createDataFrame([(7.0, 55.0, "2", " "), (8.0, 44.0, "5", "A")], "RSUBJ_ID double, AGE double, RACE_GEN string, ELIG_007 string"),
        "eosr": spark.createDataFrame(n(7.0, "1", "progression", 90.0), "RSUBJ_ID double, EOSR_003 string, EOSR_004 string, EOSRDAY_001 double"),
        "toxy": spark.createDataFrame(n(7.0, 5.0, "2", "U", "0", "", "3", None), "RSUBJ_ID double, TOXYDAY_000 double, " + ", ".join(f"TOXY_00{i} string" for i in range(1, 7))),
        "dose": spark.createDataFrame([(7.0, 3.0, 10.0), (7.0, None, None), (7.0, 20.0, None)], "RSUBJ_ID double, DOSEDAY_001 double, DOSEDAY_003 double"),
    }
    st = mapping.map_visit_form(raw, mapping.TrialConfig("V", screening_visit=1.0))
    assert rows(st["TR"], "TRLNKID", "VISITNUM", "TRSTAT", "TRORRES", "TRDTC", "EPOCH") == [
        ("NT2", 1.0, "", "NOT EVALUABLE", "", "SCREENING"), ("T1", 1.0, "", "12.0", "2010-01-01", "SCREENING"), ("T1", 2.0, "NOT DONE", "", "2010-02-10", "TREATMENT")]
    assert rows(st["RS"], "RSSEQ", "RSTESTCD", "RSORRES") == [(1.0, "NTRGRESP", "ND"), (2.0, "OVRLRESP", "SD"), (3.0, "SUMDIAM", "")]
    assert rows(st["DM"], "USUBJID", "RACE", "ARMCD", "RFXSTDTC", "RFXENDTC", "SEX") == [
        ("V-7", "BLACK OR AFRICAN AMERICAN", "B", "2010-01-04", "2010-01-11", "F"), ("V-8", "UNKNOWN", "A", "", "", "F")]
    assert rows(st["AE"], "AESEQ", "AETERM", "AESEV", "AESTDTC") == [(1.0, "Nausea", "MODERATE", "2010-01-06"), (2.0, "Alopecia", "SEVERE", "2010-01-06")]
    assert rows(st["EX"], "EXSEQ", "EXSTDTC", "EXENDTC") == [(1.0, "2010-01-04", "2010-01-11"), (2.0, "2010-01-21", "")]
    assert rows(st["DS"], "DSDECOD", "DSSTDTC") == [("DISCONTINUED", "2010-04-01")] and st["TA"].count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([("3.0", "2020-02-27", 59.0), ("ab ", "2020", None)], "id string, d string, n double").coalesce(1)
    got = df.select(sc.subject_id("S", F.col("id")), sc.shift_days(F.col("d"), 3), sc.from_offset(F.col("n"), dt.date(2010, 1, 1)), sc.day_gap(F.lit("2020-03-01"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("S-3", "2020-03-01", "2010-03-01", 3), ("S-ab", None, "", None)]


def test_load_prefers_the_first_path_and_reads_only_what_is_asked(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    dm = spark.createDataFrame([("s1", 5.0, "")], "USUBJID string, AGE double, ARM string")
    sinks.write_study(Study(spark, {"DM": dm}), a, "csv")
    sinks.write_study(Study(spark, {"DM": dm.union(dm), "EX": dm.select("USUBJID"), "ZZ": dm}), b)
    st = load_study(spark, a, b)
    assert set(st.tables) == {"DM", "EX"} and rows(st["DM"], "USUBJID", "AGE", "ARM") == [("s1", 5.0, "")]
    assert set(load_study(spark, b, domains=None).tables) == {"DM", "EX", "ZZ"} and set(load_study(spark, b, domains=("EX",)).tables) == {"EX"}


def test_sorted_output_is_in_order_across_files(spark, tmp_path):
    df = spark.createDataFrame([(f"s{n % 5}", float(n % 3), float(n)) for n in range(30)], "USUBJID string, VISITNUM double, RSSEQ double")
    sinks.write_sorted(df, "RS", str(tmp_path / "rs"), 3)
    out = spark.read.parquet(str(tmp_path / "rs")).withColumn("_f", F.input_file_name()).collect()
    by_file = {}
    for r in out:
        by_file.setdefault(r._f, []).append((r.USUBJID, r.VISITNUM, r.RSSEQ))
    assert all(v == sorted(v) for v in by_file.values())
    spans = sorted((min(v), max(v)) for v in by_file.values())
    assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_issue_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"Issue_Details": [{"dataset": "DM.xpt", "USUBJID": null, "core_id": "C1", "message": "m"},\n'
                                     ' {"dataset": "lb.xpt", "core_id": "C2"}, {"dataset": "ex.xpt", "USUBJID": "s", "message": "Failed to build x"}]}')
    found = issues.load_issues(spark, str(tmp_path))
    assert found.count() == 3 and issues.real_issues(found).count() == 2
    assert rows(issues.to_flags(found, "B2"), "subject", "rule_id", "domain") == [("", "C1", "DM"), ("s", "unknown", "EX")]
    assert issues.new_issues(found, found.filter("core_id = 'C1'")).count() == 2
    (tmp_path / "p.csv").write_text("Domain,Rule ID,Message\nDM,DD0101,x\nDM,SD1,y\n,,\n")
    assert rows(issues.load_report_rows(spark, str(tmp_path / "p.csv")), "domain", "rule_id", "message") == [("DM", "SD1", "y")]


def test_inventory_and_manifest(spark, tmp_path):
    df = inventory.with_labels(spark.createDataFrame([("s",)], "USUBJID string"), {"USUBJID": "Unique subject"})
    assert rows(inventory.column_inventory(Study(spark, {"DM": df}), "X"), "study", "dataset", "n_rows", "column", "label") == [("X", "DM", 1, "USUBJID", "Unique subject")]
    for name in "abc":
        (tmp_path / name).write_text(name)
    before = inventory.manifest(spark, str(tmp_path)).select("file", "sha256").toPandas()
    (tmp_path / "a").write_text("A"), (tmp_path / "b").unlink(), (tmp_path / "d").write_text("d")
    bad = inventory.verify_manifest(spark.createDataFrame(before), inventory.manifest(spark, str(tmp_path)))
    assert rows(bad, "file", "status") == [("a", "changed"), ("b", "missing"), ("d", "unexpected")]


def test_a_null_in_an_issue_is_not_an_empty_text(spark):
    ddl = "core_id string, dataset string, USUBJID string, variables string, `values` string, message string"
    new = spark.createDataFrame([("C1", "dm.xpt", None, "x", "1", "m")] * 3 + [("C1", "dm.xpt", "", "x", "1", "m"), ("C2", "dm.xpt", "s", "x", None, None)], ddl)
    old = spark.createDataFrame([("C1", "dm.xpt", "", "x", "1", "m"), ("C2", "dm.xpt", "s", "x", None, None)], ddl)
    assert [r.USUBJID for r in issues.new_issues(new, old).collect()] == [None] * 3


def test_enrichment_without_text_columns(make_study):
    st = make_study(RS=("USUBJID string, VISITNUM double, RSSEQ double, RSTESTCD string, RSORRES string", [("s", 1.0, 1.0, "OVRLRESP", "SD")]))
    assert enrich.new_lesion_status(st).count() == 0
