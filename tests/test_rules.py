"""Leaf semantics over value, empty and NULL; trees; the rule table; streaming."""

import pytest
from pyspark.sql import functions as F

from crosswitness.functions import leaves as lv
from crosswitness.plans.rules import P, RULES, All, Any, Rule, differs, eq, expand_prefix, single_table_rules
from conftest import SF, rows

CELLS = [("Y",), ("",), (None,), ("q",)]


@pytest.mark.parametrize("leaf, args, holds", [
    ("non_empty", (), [1, 1, 0, 1]), ("exists", (), [1, 1, 0, 1]), ("empty", (), [0, 0, 1, 0]), ("not_exists", (), [0, 0, 1, 0]),
    ("equal_to", ("Y",), [1, 0, 0, 0]), ("not_equal_to", ("Y",), [0, 1, 1, 1]),
    ("is_contained_by", (["Y", "Z"],), [1, 0, 0, 0]), ("is_not_contained_by", (["Y", "Z"],), [0, 1, 0, 1]),
    ("is_contained_by_case_insensitive", (["y", "Q"],), [1, 0, 0, 1]), ("is_not_contained_by_case_insensitive", (["y", "Q"],), [0, 1, 0, 0]),
    ("longer_than", (0,), [1, 0, 0, 1]), ("matches_regex", ("[A-Z]",), [1, 0, 0, 0]), ("not_matches_regex", ("[A-Z]",), [0, 1, 0, 1]),
])
def test_leaf(spark, leaf, args, holds):
    df = spark.createDataFrame(CELLS, "c string").coalesce(1)
    got = [r[0] for r in df.select(lv.LEAVES[leaf](F.col("c"), *args)).collect()]
    assert got == [bool(h) for h in holds]
    negated = [r[0] for r in df.select(~lv.LEAVES[leaf](F.col("c"), *args)).collect()]
    assert negated == [not h for h in got]


def test_numeric_and_date_leaves(spark):
    df = spark.createDataFrame([(1.0, "2020-01-02", "2020-01-01"), (None, "2020-01-01", "2020-01-02"), (20.0, None, "2020-01-01"), (5.0, "2020-01-01", "2020-01-01")],
                               "n double, a string, b string").coalesce(1)
    got = [tuple(r) for r in df.select(lv.less_than(F.col("n"), 5), lv.date_greater_than(F.col("a"), F.col("b"))).collect()]
    assert got == [(True, True), (False, False), (False, False), (False, True)]


def test_trees_and_absent_columns(spark):
    df = spark.createDataFrame(CELLS, "c string").coalesce(1)
    tree = Any(All(P("c"), {"not": eq("c", "Y")}), P("nowhere"))
    assert [r[0] for r in df.select(lv.compile_tree(tree, df)).collect()] == [False, True, False, True]


def test_frozen_comparators(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("y", "y")], "x string, y string").coalesce(1)
    live = [r[0] for r in df.select(lv.compile_tree(differs("x", "y"), df)).collect()]
    frozen = [r[0] for r in df.select(lv.compile_tree(differs("x", "y"), df, literal_compat=True)).collect()]
    assert live == [False, True, False] and frozen == [True, True, False]


def test_rule_table():
    assert len(RULES) == 85 and len({r.id for r in RULES}) == 85
    per = {d: sum(r.domain == d for r in RULES) for d in ("DM", "EX", "RS", "TR")}
    assert per == {"DM": 74, "EX": 5, "RS": 2, "TR": 4}
    assert sum(not r.enabled for r in RULES) == 11
    assert expand_prefix({"op": "empty", "col": "--STDTC"}, "EX")["col"] == "EXSTDTC"


def test_numeric_equality_and_unexpanded_prefix(make_study):
    st = make_study(EX=("USUBJID string, EXSEQ double, EXTRT string, EXDOSE double, EXSTDTC string",
                        [("a", 1.0, "PLACEBO", 0.0, "2020-01-01"), ("b", 2.0, "PLACEBO", 5.0, "2020-01-01"), ("c", 3.0, "PLACEBO", None, None)]))
    assert rows(single_table_rules(st), "rule_id", "subject") == [("CORE-000005", "b"), ("CORE-000005", "c"), ("CORE-000385", "c")]
    compat = rows(single_table_rules(st, literal_compat=True), "rule_id", "subject")
    assert [r for r in compat if r[0] == "CORE-000385"] == [("CORE-000385", s) for s in "abc"]


def test_rules_beyond_one_mask(make_study):
    many = tuple(Rule(f"R{n:03d}", "DM", eq("SEX", "M") if n % 2 else P("nowhere")) for n in range(150))
    st = make_study(DM=("USUBJID string, SEX string", [("a", "M"), ("b", "F")]))
    assert rows(single_table_rules(st, many), "rule_id", "subject") == [(f"R{n:03d}", "a") for n in range(1, 150, 2)]


def test_row_local_predicates_run_on_a_stream(spark, tmp_path):
    source = spark.read.parquet(f"{SF}/customer.parquet")
    stream = spark.readStream.schema(source.schema).parquet(SF + "/customer.parquet*")
    tree = All(P("c_name"), {"op": "less_than", "col": "c_acctbal", "value": 0})
    query = (stream.filter(lv.compile_tree(tree, stream)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
             .option("path", str(tmp_path / "out")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.filter("c_acctbal < 0").count()
