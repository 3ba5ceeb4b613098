"""What the third review found: thresholds as in SQL, late years, and tables built only when read."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF, rows
from crosswitness.catalog import testbed
from crosswitness.functions import scalars as sc
from crosswitness.plans import detect
from crosswitness.plans import inject as ij
from crosswitness.plans.checks import run_checks


def test_shrunk_visit_compares_doubles_as_its_sql_does(make_study, spark):
    """0.7 * 90 is 62.99..., so 63 is not small enough and the last visit is taken."""
    tr = [("s1", 1.0, "LDIAM", 90.0), ("s1", 2.0, "LDIAM", 63.0), ("s1", 3.0, "LDIAM", 80.0),
          ("s2", 1.0, "LDIAM", 100.0), ("s2", 2.0, "LDIAM", 70.0), ("s2", 3.0, "LDIAM", 80.0)]
    st = make_study(TR=("USUBJID string, VISITNUM double, TRTESTCD string, TRSTRESN double", tr),
                    RS=("USUBJID string, VISITNUM double, RSORRES string", [(s, v, "SD") for s in ("s1", "s2") for v in (1.0, 2.0, 3.0)]))
    who = spark.createDataFrame([("s1",), ("s2",)], "USUBJID string")
    changed, _ = ij.inject(st, "A01", who)
    assert rows(changed["RS"].filter("RSORRES = 'PD'"), "USUBJID", "VISITNUM") == [("s1", 3.0), ("s2", 2.0)]


def test_years_beyond_9999_have_no_sign(spark):
    df = spark.createDataFrame([(3_000_000.0, "9999-12-30")], "n double, d string")
    got = df.select(sc.from_offset(F.col("n"), dt.date(2010, 1, 1)), sc.shift_days(F.col("d"), 3)).first()
    assert tuple(got) == ("10223-09-22", "10000-01-02")


def test_a_query_builds_only_the_domains_it_reads(spark):
    testbed._STUDIES.clear()
    st = testbed.study(spark, SF)
    assert run_checks(st, ["A10"]).count() > 0
    assert set(st.tables._made) == {"DM", "EX"} and set(st.loads._made) == {"DM"}
    assert set(st.with_tables(DM=st["DM"]).tables) == set(st.tables) and set(st.tables._made) == {"DM", "EX"}


def test_scenarios_copy_only_what_is_read(spark):
    testbed._STUDIES.clear()
    st = testbed.study(spark, SF)
    free = st["DM"].select("USUBJID").orderBy("USUBJID").limit(3).withColumn("archetype", F.lit("A08"))
    scenarios = detect.scenario_study(st, free, ("A08",))
    detect.scenario_flags(scenarios, ("A08",))
    assert set(scenarios.tables._made) == {"DM", "TA"} and "TR" not in st.tables._made


def test_an_injection_makes_only_the_table_that_is_read(spark):
    testbed._STUDIES.clear()
    st = testbed.study(spark, SF)
    changed, _ = ij.inject(st, "A04", st["DM"].select("USUBJID"))
    assert changed["RS"].filter("VISITNUM <> floor(VISITNUM)").count() > 0
    assert "TR" not in st.tables._made and "TR" not in changed.tables._made
