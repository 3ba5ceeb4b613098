"""Domains that lie by subject: experiments shuffle none of them and give the rows of the plain way."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from crosswitness.catalog import testbed
from crosswitness.plans import detect
from crosswitness.plans import differential
from crosswitness.plans import inject as ij
from crosswitness.plans.checks import flag_counts, run_checks
from crosswitness.sources.staging import staging_root, written_by_subject
from crosswitness.sources.study import Deferred, Study


@pytest.fixture(scope="module")
def lying(spark):
    testbed._STUDIES.clear()
    return testbed.study(spark, SF)


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_checks_by_subject_and_visit_shuffle_nothing(spark, lying):
    assert lying.buckets > 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for check in ("A01", "A06", "A14", "S5"):
            assert exchanges(run_checks(lying, [check]))[1] == 0, check
        who = lying["DM"].select("USUBJID").distinct()
        for archetype, table in (("H04", "TR"), ("A04", "RS"), ("A20", "RS")):
            changed, _ = ij.inject(lying, archetype, who)
            assert exchanges(changed[table])[1] == 0, archetype
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_experiment_by_subject_equals_the_plain_one(spark, lying):
    names = ("A01", "A06", "A09", "A16")
    plain = replace(lying, buckets=0)
    who = lying["DM"].select("USUBJID").distinct().orderBy("USUBJID").limit(20)
    plan = who.withColumn("archetype", F.explode(F.array(*[F.lit(a) for a in names]))).select("archetype", "USUBJID")
    one, two = (differential.experiment(s, plan, names).after for s in (lying, plain))
    assert rows(one, "injected", "subject", "archetype", "flags") == rows(two, "injected", "subject", "archetype", "flags")


def test_co_occurrence_runs_only_the_checks_it_asks_for(spark, lying, monkeypatch):
    seen = []
    monkeypatch.setattr(detect, "flag_counts", lambda s, ids, *a: seen.append(tuple(ids)) or flag_counts(s, ids, *a))
    plan = lying["DM"].select("USUBJID").distinct().orderBy("USUBJID").limit(5).withColumn("archetype", F.explode(F.array(F.lit("A08"), F.lit("A13"))))
    got = detect.co_occurrence(lying, plan, plan, ("A08", "A13"))
    assert set(seen) == {("A08", "A13")} and got.count() == 5


def test_perturbed_tables_keep_their_rows_by_subject(spark, lying):
    dropped = ij.drop_fraction(lying, 0.25, 7)
    plain = ij.drop_fraction(replace(lying, buckets=0), 0.25, 7)
    for d in ("TR", "RS", "TU"):
        assert dropped.raw(d).exceptAll(plain.raw(d)).count() == 0 and plain.raw(d).exceptAll(dropped.raw(d)).count() == 0


def test_responses_take_their_sums_from_measurements_that_are_made(spark, lying):
    lying["TR"]
    made = {d: lying.tables[d] for d in ("TR", "RS")}
    v = testbed.visits(spark, SF, buckets=lying.buckets)
    v = written_by_subject(v, f"{staging_root(spark)}/visits", lying.buckets)
    lines = testbed.table(spark, SF, "lineitem")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with_tr, without = testbed._rs(v, lines, lying.buckets, made["TR"]), testbed._rs(v, lines, lying.buckets)
        assert exchanges(with_tr)[1] == 0
        names = made["RS"].columns
        assert with_tr.columns == without.columns == names
        assert rows(with_tr, *names) == rows(without, *names) == rows(made["RS"], *names)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_measurements_are_made_before_responses(spark):
    asked = []
    maker = lambda d, df: (lambda: (asked.append(d), df)[1])
    some = testbed.build_study(spark, SF)
    some = Study(spark, Deferred({d: maker(d, some.tables[d]) for d in some.tables})).measured_on_demand()
    run_checks(some, ["A01"])
    assert asked[0] == "TR"


def test_tables_by_subject_are_read_in_order(spark, lying):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lying["RS"].select("USUBJID", "RSSEQ").join(lying["EX"].select("USUBJID", "EXSEQ"), "USUBJID")
        plan = plan._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Sort [" not in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_values_on_demand_are_made_side_by_side_and_once():
    meet, made = Barrier(2, timeout=20), []
    both = Deferred({d: lambda d=d: (meet.wait(), made.append(d), d)[2] for d in "ab"})
    assert not both.begun("a")
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(both.__getitem__, "abab")) == list("abab")
    assert sorted(made) == ["a", "b"] and both.begun("a")
    with pytest.raises(KeyError):
        both["c"]
