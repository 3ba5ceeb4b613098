from pyspark.sql import functions as F

from crosswitness.plans import audit
from crosswitness.plans import flagsets as fs
from crosswitness.operators.skew import Load
from crosswitness.plans.checks import FLAG_SCHEMA
from crosswitness.sources import sinks
from conftest import rows

PAIRS = "subject string, rule_id string"


def flags(spark, *pairs):
    return spark.createDataFrame(list(pairs), PAIRS)


def test_jaccard_cases(spark):
    a = flags(spark, ("s1", "r1"), ("s2", "r2"))
    j = lambda x, y: fs.jaccard(x, y).first().jaccard
    assert j(a, flags(spark, ("s1", "r1"), ("s3", "r3"))) == 1 / 3
    assert j(a, a.union(a)) == 1.0
    assert j(flags(spark, ("s1", "r1")), flags(spark, ("s2", "r2"))) == 0.0
    assert j(flags(spark), flags(spark)) == 1.0


def test_difference_recall_and_reports(spark):
    a = flags(spark, ("s1", "r1"), ("s2", "r2"), ("s3", "r3"))
    b = flags(spark, ("s1", "r1"), ("s2", "r2"))
    assert rows(fs.only_in(a, b), "subject", "rule_id") == [("s3", "r3")]
    assert rows(fs.recall_by_rule(b, a), "rule_id", "recall") == [("r1", 1.0), ("r2", 1.0), ("r3", 0.0)]
    assert fs.regression_report(b, a).first().asDict() == {"track": "A", "jaccard": 0.6667, "l1_flags": 2, "core_flags": 3, "overlap": 2, "pass_threshold": False}
    assert fs.novelty_report(a, b).first().only_ours == 1


def test_matrix_has_every_pair_of_sources(spark):
    f = spark.createDataFrame([("s1", "r", "A"), ("s1", "r", "B"), ("s2", "r", "A")], PAIRS + ", source string")
    assert {(r[0], r[1]): r.jaccard for r in fs.jaccard_matrix(f, ["A", "B", "C"]).collect()} == {
        ("A", "A"): 1.0, ("A", "B"): 0.5, ("A", "C"): 0.0, ("B", "A"): 0.5, ("B", "B"): 1.0, ("B", "C"): 0.0, ("C", "A"): 0.0, ("C", "B"): 0.0, ("C", "C"): 1.0}


def test_mcnemar_and_interval(spark):
    df = spark.createDataFrame([("x", True, False)] * 12 + [("x", False, False)] * 8 + [("y", True, True)], "g string, a boolean, b boolean")
    got = {r.g: r for r in fs.mcnemar(df, F.col("a"), F.col("b"), ["g"]).collect()}
    assert (got["x"].b, got["x"].c, got["x"].p_value) == (12, 0, round(2 / 2 ** 12, 6)) and got["y"].p_value == 1.0
    ci = spark.createDataFrame([(20, 20), (0, 20), (10, 20)], "k int, n int").select(fs.rate_interval(F.col("k"), F.col("n")).alias("c")).collect()
    assert ci[0].c.high == 1.0 and ci[1].c.low == 0.0 and ci[2].c.low < 0.5 < ci[2].c.high


def test_kappa_against_the_formula(spark):
    data = [(3, 0, 0), (2, 1, 0), (0, 3, 0), (1, 1, 1)]
    got = fs.fleiss_kappa(spark.createDataFrame(data, "valid int, invalid int, uncertain int"), ["valid", "invalid", "uncertain"]).first()
    p = [(sum(x * x for x in r) - 3) / 6 for r in data]
    chance = sum((sum(r[c] for r in data) / 12) ** 2 for c in range(3))
    assert got.kappa == round((sum(p) / 4 - chance) / (1 - chance), 4)
    assert (got.unanimous_valid, got.majority_valid, got.any_invalid, got.majority_uncertain) == (1, 2, 3, 0)


def test_bootstrap_is_repeatable_and_brackets_the_rate(spark):
    items = spark.createDataFrame([(n < 15,) for n in range(20)], "hit boolean")
    one, two = (fs.bootstrap_rate(items, F.col("hit")).first() for _ in range(2))
    assert one == two and one.rate_low < 0.75 < one.rate_high


def test_consensus_and_changed_rows(spark):
    votes = spark.createDataFrame([("a", "TP"), ("a", "TP"), ("a", "FP"), ("a", "error"), ("b", "X"), ("b", "Y")], "i string, v string")
    assert rows(fs.consensus(votes, "i", "v"), "i", "consensus", "agreement_rate") == [("a", "TP", 0.667), ("b", "X", 0.5)]
    x = spark.createDataFrame([(1,), (1,), (2,)], "v int")
    assert rows(fs.changed_rows(x, spark.createDataFrame([(1,), (2,), (3,)], "v int")), "v", "difference") == [(1, -1), (3, 1)]


def _flags(spark, n=40):
    data = [(f"s{i % 3}", "1.0", "L1" if i % 4 else "L3", "A01", "A01", "RS", f"RS/s{i % 3}/{i}", "violation", "m", [("T", str(i))], ["A01"], "RULES") for i in range(n)]
    return spark.createDataFrame(data, FLAG_SCHEMA)


def test_chain_verifies_and_reports_tampering(spark):
    entries = audit.number(audit.to_traces(_flags(spark).union(_flags(spark)), "2025-01-01 00:00:00"))
    assert entries.count() == 40  # repeated flags collapse
    chained = audit.chain(entries, segment=5).cache()
    assert audit.broken_links(chained).count() == 0
    assert audit.tips(chained).agg(F.max("entries")).first()[0] <= 5
    forged_hash = chained.withColumn("entry_hash", F.when((F.col("subject") == "s1") & (F.col("seq") == 2), F.lit("0" * 64)).otherwise(F.col("entry_hash")))
    assert rows(audit.broken_links(forged_hash), "subject", "seq") == [("s1", 2), ("s1", 3)]
    forged_cell = chained.withColumn("severity", F.when(F.col("seq") == 4, "info").otherwise(F.col("severity")))
    assert audit.broken_links(forged_cell).count() == 3
    dropped = chained.filter("NOT (subject = 's0' AND seq = 1)")
    assert rows(audit.broken_links(dropped), "subject", "seq") == [("s0", 2)]
    truncated = chained.filter("NOT (subject = 's1' AND seq = 12)")  # links alone cannot show a missing end; the run digest does
    assert audit.broken_links(truncated).count() == 0 and audit.seal(chained).first() != audit.seal(truncated).first()
    assert audit.seal(chained).first() == audit.seal(audit.chain(entries, segment=5)).first()


def test_null_and_empty_text_hash_differently(spark):
    entries = audit.number(audit.to_traces(_flags(spark, 6), "2025-01-01 00:00:00")).withColumn("reviewer_label", F.lit(None).cast("string"))
    chained = audit.chain(entries)
    assert audit.broken_links(chained).count() == 0
    assert audit.broken_links(chained.withColumn("reviewer_label", F.lit(""))).count() == 6
    one = spark.createDataFrame([(1, "1", None, True)], "n int, t string, z string, b boolean")
    from crosswitness.functions.scalars import canonical_json

    assert one.select(canonical_json({c: F.col(c) for c in one.columns})).first()[0] == '{"b":true,"n":1,"t":"1","z":null}'


def test_numbering_is_the_same_for_hot_subjects(spark):
    traces = audit.to_traces(_flags(spark), "2025-01-01 00:00:00")
    assert rows(audit.number(traces), "flag_id", "seq") == rows(audit.number(traces, Load(40, 14, 2)), "flag_id", "seq")


def test_trace_columns_and_reads(spark):
    chained = audit.chain(audit.number(audit.to_traces(_flags(spark), "2025-01-01 00:00:00")))
    assert set(audit.TRACE_COLUMNS) | {"prev_hash", "entry_hash", "seq", "segment"} == set(chained.columns) and len(audit.TRACE_COLUMNS) + 2 == 15
    assert [r.seq for r in audit.by_subject(chained, "s1").collect()] == list(range(13))
    assert audit.by_archetype(chained, "A01").count() == 40 and audit.tip(chained).count() == 3


def test_append_refuses_known_ids(spark, tmp_path):
    path = str(tmp_path / "log")
    traces = audit.to_traces(_flags(spark, 10), "2025-01-01 00:00:00")
    assert sinks.append_traces(traces, path, "one").count() == 0
    more = audit.to_traces(_flags(spark, 12), "2025-01-02 00:00:00")
    assert sinks.append_traces(more, path, "two").count() == 10
    sinks.append_traces(more, path, "two")  # a repeated run replaces itself
    log = spark.read.parquet(path)
    assert log.count() == 12 and log.select("flag_id").distinct().count() == 12
