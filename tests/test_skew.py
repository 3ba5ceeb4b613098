"""The split paths give the same rows as the plain ones, with one key far above the rest."""

import random

import pytest
from pyspark.sql import functions as F

from crosswitness.catalog.testbed import build_study, visits
from crosswitness.operators import ordered
from crosswitness.operators.skew import Load, keyed_join, measure
from crosswitness.plans.checks import run_checks
from conftest import SF, rows

HOT = Load(rows=100, largest=60, rows_per_task=5)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    data = [("hot" if n % 3 == 0 else f"k{n % 40}", n % 7, rnd.randint(0, 9)) for n in range(600)]
    data += [("hot", 1, 1)] * 200  # full copies of one row
    return spark.createDataFrame(data, "k string, v int, x int")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_keyed_join(spark, skewed, how):
    facts = spark.createDataFrame([("hot", "a"), ("k1", "b"), ("k4", "c"), ("zz", "d")], "k string, f string")
    plain, split = (keyed_join(skewed, facts, ["k"], how, load) for load in (None, HOT))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))


def test_hot_rows_are_not_shuffled_for_the_join(spark, skewed):
    facts = spark.createDataFrame([("hot", "a"), ("k1", "b")], "k string, f string")
    text = keyed_join(skewed, facts, ["k"], "inner", HOT)._jdf.queryExecution().toString()
    assert "Union" in text and "BroadcastHashJoin" in text


def test_measure(spark, skewed):
    got = measure({"a": (skewed, ("k",)), "none": (skewed.filter("k = ''"), ("k",))})
    assert (got["a"].rows, got["a"].largest) == (800, 400)
    assert got["none"] == Load(0, 0) and not got["a"].hot and Load(800, 400, 100).hot


def test_limit_never_allows_more_hot_keys_than_the_bound():
    assert Load(rows=10 ** 12, largest=10 ** 9, rows_per_task=10).limit * 20_000 >= 10 ** 12


@pytest.fixture(scope="module")
def series(spark):
    rnd = random.Random(5)
    data = [("hot", n / 2, None if n % 11 == 0 else rnd.randint(0, 1000)) for n in range(500)]
    data += [(f"k{n % 9}", float(n), rnd.randint(0, 1000)) for n in range(200)]
    return spark.createDataFrame(data, "k string, t double, x int")


@pytest.mark.parametrize("op", [ordered.previous, ordered.running_min])
def test_order_dependent_values(series, op):
    plain = op(series, ["k"], "t", "x", "y")
    split = op(series, ["k"], "t", "x", "y", HOT, F.floor(F.col("t") / 7))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, plain.select("k", "t", "y").collect()), key=key) == sorted(map(tuple, split.select("k", "t", "y").collect()), key=key)


def test_position(series):
    order = [F.col("t")]
    plain = ordered.position(series, ["k"], order, "n", F.floor("t"))
    split = ordered.position(series, ["k"], order, "n", F.floor(F.col("t") / 7), HOT)
    assert rows(plain, "k", "t", "n") == rows(split, "k", "t", "n")


@pytest.fixture(scope="module")
def gaps(spark):
    """NULL keys, a NULL order (hence a NULL bucket) per key, and NULL values."""
    data = [(k, float(t) if t else None, None if t % 5 == 0 else t * 3 % 17) for k in ("a", None) for t in range(30)]
    return spark.createDataFrame(data, "k string, t double, x int")


def test_split_paths_keep_rows_with_nulls(gaps):
    bucket = F.floor(F.col("t") / 7)
    texts = lambda df, out: sorted(map(str, df.select("k", "t", "x", out).collect()))
    for op in (ordered.previous, ordered.running_min):
        assert texts(op(gaps, ["k"], "t", "x", "y"), "y") == texts(op(gaps, ["k"], "t", "x", "y", HOT, bucket), "y")
    order = [F.col("t")]
    plain, split = (ordered.position(gaps, ["k"], order, "n", bucket, load) for load in (None, HOT))
    assert texts(plain, "n") == texts(split, "n") and split.count() == 60


def test_checks_are_the_same_with_split_keys(spark):
    ids = ("A07", "A17")
    plain = build_study(spark, SF)
    split = build_study(spark, SF, rows_per_task=4).measured(rows_per_task=20)
    assert split.load("RS").hot and split.load("TR").hot and split.load("DM by ARMCD").hot
    cols = ("rule_id", "record_id", "subject", "visit")
    want = sorted(map(str, run_checks(plain, ids).select(*cols).collect()))
    # one job per group keeps the split plans small
    got = sorted(str(r) for i in ids for r in run_checks(split, [i]).select(*cols).collect())
    assert want == got


def test_visit_numbers_with_split_customers(spark):
    assert rows(visits(spark, SF), "o_orderkey", "VISITNUM") == rows(visits(spark, SF, rows_per_task=2), "o_orderkey", "VISITNUM")
