"""Steps keyed by order are dealt by the size of the study, not by the session's number of partitions."""

import re

from crosswitness.catalog import testbed
from crosswitness.operators.skew import Load, measure

SF = "/root/testdata/sf0.001"


def test_steps_by_order_take_as_many_partitions_as_buckets(spark):
    v = testbed.visits(spark, SF, buckets=13)
    for df in (testbed._tr(spark, SF, v, 2_000_000, 13), testbed._rs(v, testbed.table(spark, SF, "lineitem"), 13)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"RepartitionByExpression \[o_orderkey#\d+L?\], 13", plan)) == 2


def test_measure_counts_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None), (None, None), (None, None)], "k int, t string")
    found = measure({"t": (df, ("k", "t")), "none": (df.limit(0), ("k",))}, 10)
    assert found == {"t": Load(6, 3, 10), "none": Load(0, 0, 10)}
