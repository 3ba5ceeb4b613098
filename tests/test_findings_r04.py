"""What the fourth review found: work that is repeated per archetype or scenario, and whole files in one row."""

import gzip
import hashlib
import random

from pyspark.sql import functions as F

from conftest import SF, rows
from crosswitness.catalog import testbed
from crosswitness.plans import audit, detect
from crosswitness.plans import differential as df
from crosswitness.plans import facts as fx
from crosswitness.plans import inject as ij
from crosswitness.plans.checks import run_checks, write_flags
from crosswitness.sources import inventory


def _study(spark):
    testbed._STUDIES.clear()
    return testbed.study(spark, SF)


def test_a_fact_that_no_archetype_changes_is_made_once(spark, monkeypatch):
    st, calls = _study(spark), []
    key, build = fx.FACTS["shrunk_visit"]
    monkeypatch.setitem(fx.FACTS, "shrunk_visit", (key, lambda s: calls.append(1) or build(s)))
    few = st["DM"].select("USUBJID").distinct().orderBy("USUBJID").limit(5)
    plan = few.withColumn("archetype", F.explode(F.array(*map(F.lit, ("A07", "A19", "A20")))))
    found = df.experiment(st, plan, ("A07", "A19", "A20"), ("A01", "A20"))
    assert len(calls) == 2  # once for the unchanged study, once for all archetypes
    assert found.tried.count() == 15


def test_made_facts_hold_until_one_of_their_tables_changes(spark):
    st = fx.with_facts(_study(spark), ["ovr_visit", "tu_lesion"], lambda d, name: d)
    assert set(st.with_tables(TU=st.raw("TU")).facts) == {"ovr_visit"}
    assert set(st.with_made("RS", lambda: st.raw("RS")).facts) == {"tu_lesion"}
    assert fx.fact(st, "tu_lesion") is st.facts["tu_lesion"][1]


def test_a_robustness_run_writes_no_perturbed_table(spark, monkeypatch):
    st, kept = _study(spark), []
    monkeypatch.setattr(df, "written_by_subject", lambda d, path, n: kept.append(path) or testbed.written_by_subject(d, path, n))
    curve = df.robustness(st, ("A04", "A06"), levels=(0.0, 0.5))
    assert curve.count() == 4 and df.stability(curve).count() == 1
    assert [p.rsplit("/", 2)[1:] for p in kept] == [["broken", "RS"]]


def test_an_exact_share_parts_copies_and_leaves_other_rows_where_they_lie(spark):
    data = spark.createDataFrame([(f"S{i // 7}", float(i)) for i in range(70)], "USUBJID string, x double")
    thrice = data.unionByName(data).unionByName(data)
    for share, n in ((0.0, 0), (0.1, 21), (0.5, 105), (0.502, 105), (1.0, 210)):
        assert ij._fraction(thrice, 5, share).filter("_chosen").count() == n
    assert ij._fraction(thrice, 5, 0.001, True).filter("_chosen").count() == 1
    first = data.withColumn("_h", F.xxhash64("USUBJID", "x", F.lit(5))).orderBy("_h").limit(7).drop("_h")
    plain = ij._fraction(data, 5, 0.1)
    assert rows(plain.filter("_chosen"), "USUBJID", "x") == rows(first, "USUBJID", "x") and plain.count() == 70
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()


def test_a_manifest_hashes_files_that_no_row_holds(spark, tmp_path, monkeypatch):
    some = random.Random(4).randbytes(300_000)
    files = {"a.bin": some, "b.bin": some + b"\n", "c.bin": b"\xef\xbb\xbf" + some, "d e{1}.bin": b"\r\n" * 3000, "e.bin": b"\n" * 2000,
             "f.bin": b"x" * 50_000, "g.bin.gz": gzip.compress(some), "h.bin": some[:900], "j.bin": b"\n\n" + some + b"\r\n\n"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(inventory, "WHOLE", 1000, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        got = rows(inventory.manifest(spark, str(tmp_path)), "file", "length", "sha256")
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == sorted((n, len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items())


def test_flags_that_lie_by_subject_are_numbered_where_they_lie(spark, tmp_path):
    st, ids = _study(spark), ("A04", "A06", "A08", "A18", "S1", "S8")
    flags = write_flags(st, str(tmp_path / "flags"), ids)
    assert rows(flags, "subject", "rule_id", "record_id") == rows(run_checks(st, ids), "subject", "rule_id", "record_id")
    twice = audit.to_traces(flags.unionByName(flags), "2025-01-01 00:00:00")
    numbered = audit.number(audit.to_traces(flags, "2025-01-01 00:00:00"))
    assert rows(numbered, "subject", "flag_id", "seq") == rows(audit.number(twice), "subject", "flag_id", "seq")
    assert "Exchange" not in numbered._jdf.queryExecution().executedPlan().toString()


def test_counts_of_all_archetypes_are_read_in_one_scan(spark):
    st = _study(spark)
    plan = st["DM"].select("USUBJID").distinct().withColumn("archetype", F.explode(F.array(*map(F.lit, ("A04", "A12", "A20")))))
    found = df.experiment(st, plan, ("A04", "A12", "A20"), ("A04", "A07", "A12", "A20"))
    assert found.after._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert found.before._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert {r.injected for r in found.after.select("injected").distinct().collect()} == {"A04", "A12", "A20"}


def test_the_lookup_is_judged_from_files(spark):
    tried, hits = df.lookup_hits(_study(spark))
    assert all("Join" not in d._jdf.queryExecution().optimizedPlan().toString() for d in (tried, hits))
    assert hits.join(tried, "USUBJID", "left_anti").count() == 0 < hits.count()


def test_joint_injections_keep_one_version_of_a_table(spark, tmp_path, monkeypatch):
    st = _study(spark)
    monkeypatch.setattr(detect, "staging_root", lambda s: str(tmp_path))
    plan = st["DM"].select("USUBJID").distinct().withColumn("archetype", F.explode(F.array(F.lit("A12"), F.lit("A13"))))
    found = detect.co_occurrence(st, plan, plan, ("A12", "A13"))
    assert found.count() > 0 and sorted(p.name for p in (tmp_path / "joint").glob("*/DM")) == ["DM"]
