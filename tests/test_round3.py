"""Many-to-many joins, numbering by ranges, experiments without copies, statistics in bounded work, a log of several runs."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from crosswitness.catalog.testbed import study as catalog_study
from crosswitness.operators.ordered import numbered
from crosswitness.operators.skew import Load, measure, pair_join
from crosswitness.operators.temporal import newest_before, within_days
from crosswitness.plans import audit, detect, differential, flagsets
from crosswitness.plans.checks import run_checks


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(8)
    key = lambda n: None if n % 17 == 0 else "hot" if n % 3 == 0 else f"k{rng.randrange(60)}"
    left = [(key(n), n % 5, n) for n in range(900)] + [("only", 1, 1)] * 90
    right = [(key(n), n % 4) for n in range(400)] + [("few", 1), ("hot", 9)]
    return spark.createDataFrame(left, "k string, v int, n int"), spark.createDataFrame(right, "k string, w int")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("limit", [4, 100, 2500])
def test_pair_join_equals_the_plain_join(sides, how, limit):
    left, right = sides
    found = measure({"l": (left, ("k",)), "r": (right, ("k",))}, limit)
    got = pair_join(left, right, ["k"], how, (found["l"], found["r"]))
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_no_cell_of_a_hot_key_holds_many_pairs(spark, sides):
    """A third of both sides has one key; its pairs spread evenly over the shuffle's tasks."""
    left = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id")
    right = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.col("id").alias("r"))
    found = measure({"l": (left, ("k",)), "r": (right, ("k",))}, 10_000)
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = pair_join(left, right, ["k"], loads=(found["l"], found["r"])).filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = sorted(r["count"] for r in got)
    assert sum(sizes) == 2_000_000 and len(sizes) >= 14 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_other_kinds_are_refused(sides):
    with pytest.raises(ValueError):
        pair_join(*sides, ["k"], "full_outer", (Load(1, 1), Load(1, 1)))


def test_numbering_by_ranges(spark, tmp_path):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), 3 if n % 2 else rng.randrange(50), n) for n in range(700)]
    df = spark.createDataFrame(data, "k string, t int, n int").repartition(4)
    got = numbered(df, ["k"], [F.col("t").asc(), F.col("n").asc()], "p", str(tmp_path / "a"), 6).collect()
    want = {}
    for k, t, n in sorted(data, key=lambda r: (r[1], r[2])):
        want[k, n] = sum(1 for a in want if a[0] == k) + 1
    assert {(r.k, r.n): r.p for r in got} == want
    ties = numbered(df.select(F.lit(1).alias("x")), [], [F.col("x").asc()], "p", str(tmp_path / "b"), 6)
    assert sorted(r.p for r in ties.collect()) == list(range(1, 701))
    assert numbered(df.limit(0), [], [F.col("t").asc()], "p", str(tmp_path / "c")).count() == 0


# -- experiments ------------------------------------------------------------------------------------

def some_subjects(st, n=12):
    return st["DM"].select("USUBJID").distinct().orderBy("USUBJID").limit(n)


@pytest.mark.parametrize("names", [("A20", "A06", "A16", "H04")])
def test_experiment_equals_the_copies(spark, names):
    st = catalog_study(spark, SF)
    who = some_subjects(st)
    plan = who.withColumn("archetype", F.explode(F.array(*[F.lit(a) for a in names]))).select("archetype", "USUBJID")
    found = differential.experiment(st, plan, names)
    scenarios, flags = detect.scenario_flags_of(st, names, who, differential.LOCAL)
    assert rows(found.newly_flagged(), "injected", "subject", "archetype") == rows(detect.newly_flagged(flags), "injected", "subject", "archetype")
    old = {r.archetype: r.flag_delta for r in detect.delta_detection(flags, scenarios).collect()}
    assert {r.injected: r.flag_delta for r in found.deltas(names).collect()} == old


def test_arm_scenarios_equal_one_cohort_run_each(spark, make_study):
    dm = [("S", "a", "X", "Arm X"), ("S", "b", "X", "Arm X"), ("T", "b", "Y", "Arm Y"), ("S", "c", "X", None), ("S", "d", "Y", "Arm Y"),
          ("S", "e", "Z", "Arm Z"), ("S", "f", "W", None), ("S", "g", "W", "Arm W"), ("S", "h", None, "none")]
    st = make_study(DM=("STUDYID string, USUBJID string, ARMCD string, ARM string", dm)).measured()
    got = {r.USUBJID: (r.flag_delta, r.hit) for r in differential.arm_scenarios(st, st["DM"].select("USUBJID")).collect()}
    for s in "abcdefg":
        one = spark.createDataFrame([(s,)], "USUBJID string")
        want = detect.cohort_detection(st, "A17", one).first()
        assert got[s] == (want.total_flag_delta or 0, want.newly_flagged_subjects > 0), s
    assert "h" not in got


def test_robustness_equals_a_run_per_level(spark):
    st = catalog_study(spark, SF)
    fast = {(r.perturbation, r.level): (r.archetype_flags, r.a04_flags, r.delta_vs_clean) for r in differential.robustness(st, levels=(0.0, 0.5)).collect()}
    slow = {(r.perturbation, r.level): (r.archetype_flags, r.a04_flags, r.delta_vs_clean) for r in detect.robustness(st, levels=(0.0, 0.5)).collect()}
    assert fast == slow
    summary = differential.stability(spark.createDataFrame(
        [("missing", 0.0, 10, 2, 0), ("missing", 0.5, 7, 1, -3), ("orphan_links", 0.15, 12, 2, 2), ("fractional_visits", 0.15, 15, 7, 5)],
        "perturbation string, level double, archetype_flags long, a04_flags long, delta_vs_clean long")).first()
    assert tuple(summary) == (0, 2, True, 0, True)


# -- statistics -------------------------------------------------------------------------------------

def test_binomial_tail_is_exact(spark):
    pairs = [(0, 1), (0, 40), (1, 2), (3, 9), (5, 10), (20, 45), (21, 43), (400, 900), (1000, 2100)]
    df = spark.createDataFrame(pairs, "k long, n long").select("k", "n", flagsets.binomial_tail(F.col("k"), F.col("n")).alias("p"))
    for r in df.collect():
        want = Fraction(sum(math.comb(r.n, i) for i in range(r.k + 1)), 2 ** r.n)
        assert abs(r.p / float(want) - 1) < 1e-10, (r.k, r.n)


def test_a_billion_discordant_pairs(spark):
    n = 10 ** 9
    ks = [n // 2 - 40_000, n // 2 - 15_811, n // 2 - 100]
    df = spark.createDataFrame([(k, n) for k in ks], "k long, n long").select("k", flagsets.binomial_tail(F.col("k"), F.col("n")).alias("p"))
    for r in df.collect():
        z = (r.k + 0.5 - n / 2) / math.sqrt(n / 4)
        assert abs(r.p - 0.5 * math.erfc(-z / math.sqrt(2))) < 1e-7


def test_resampling_is_spread_and_unchanged_by_the_block_size(spark, monkeypatch):
    items = spark.range(50).select((F.col("id") % 5 != 0).alias("hit"))
    whole = flagsets.bootstrap_rate(items, F.col("hit"), 200).first()
    monkeypatch.setattr(flagsets, "DRAWS", 7)
    assert flagsets.bootstrap_rate(items, F.col("hit"), 200).first() == whole
    assert whole.rate_low < 0.8 < whole.rate_high and whole.f1_high > whole.f1_low


# -- a log of several runs --------------------------------------------------------------------------

COLUMNS = ("what", "seq")


def run_of(spark, n, start=0):
    return spark.createDataFrame([(f"u{i % 3}", i, f"e{i}") for i in range(start, start + n)], "subject string, at long, what string")


def test_runs_form_one_chain(spark, tmp_path):
    log = audit.ChainLog(spark, str(tmp_path / "log"), COLUMNS, 4)
    for n, (size, start) in enumerate(((10, 0), (7, 10), (30, 17))):
        assert log.append(run_of(spark, size, start), f"r{n}", ["at"]) == n
    assert log.problems().count() == 0 and log.entries().count() == 47
    whole = audit.chain(audit.position(run_of(spark, 47), ["subject"], [F.col("at")], "seq", F.col("at")).withColumn("seq", F.col("seq") - 1), COLUMNS, 4)
    assert rows(log.entries(), "subject", "seq", "prev_hash", "entry_hash") == rows(whole, "subject", "seq", "prev_hash", "entry_hash")
    digests = [r.digest for r in log.runs().orderBy("run").collect()]
    assert log.consistent(digests[0], digests[2]) and log.consistent(digests[1], digests[1])
    assert not log.consistent(digests[2], digests[0]) and not log.consistent("other", digests[2])


def test_the_newest_run_can_be_repeated_and_an_older_one_not(spark, tmp_path):
    log = audit.ChainLog(spark, str(tmp_path / "log"), COLUMNS, 4)
    log.append(run_of(spark, 5), "a", ["at"])
    log.append(run_of(spark, 5, 5), "b", ["at"])
    before = rows(log.entries(), "subject", "seq", "entry_hash")
    assert log.append(run_of(spark, 5, 5), "b", ["at"]) == 1
    assert rows(log.entries(), "subject", "seq", "entry_hash") == before and log.problems().count() == 0
    with pytest.raises(ValueError):
        log.append(run_of(spark, 1), "a", ["at"])


def test_changes_and_deleted_runs_are_reported(spark, tmp_path):
    def fresh(name):
        log = audit.ChainLog(spark, str(tmp_path / name), COLUMNS, 4)
        for n in range(3):
            log.append(run_of(spark, 9, 9 * n), f"r{n}", ["at"])
        return log

    kinds = lambda log: {r.problem for r in log.problems().collect()}
    log = fresh("forged")
    forged = log.entries().filter("run = 1").drop("run").withColumn("what", F.when(F.col("at") == 12, "lie").otherwise(F.col("what")))
    spark.createDataFrame(forged.collect(), forged.schema).write.mode("overwrite").parquet(f"{log.path}/entries/run=1")
    assert {(r.problem, r.subject) for r in log.problems().collect()} == {("link", "u0")}
    log = fresh("cut")
    spark.createDataFrame([], log.entries().drop("run").schema).write.mode("overwrite").parquet(f"{log.path}/entries/run=1")
    assert {"number", "run"} <= kinds(log)
    log = fresh("tail")
    spark.createDataFrame([], log.entries().drop("run").schema).write.mode("overwrite").parquet(f"{log.path}/entries/run=2")
    assert {"tail", "run"} <= kinds(log)


# -- joins on time, exact sums, sketches --------------------------------------------------------------

def dated(spark, n, seed):
    rng = random.Random(seed)
    return spark.createDataFrame([("hot" if i % 3 == 0 else f"k{rng.randrange(9)}", i, None if i % 19 == 0 else f"2020-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}") for i in range(n)],
                                 "k string, n int, d string")


@pytest.mark.parametrize("limit", [3, 10 ** 6])
def test_time_joins_equal_plain_ones(spark, limit):
    left, right = dated(spark, 150, 1), dated(spark, 130, 2).withColumnsRenamed({"n": "m", "d": "e"})
    got = within_days(left, right, ["k"], F.col("d"), F.col("e"), 7, limit)
    want = left.join(right, "k").filter(F.abs(F.datediff("d", "e")) <= 7)
    assert rows(got, "n", "m") == rows(want, "n", "m") and want.count() > 50
    seen = newest_before(left, right, ["k"], F.col("d"), F.col("e"), ["m", "e"], "m", "last", limit)
    plain = left.join(right, (left.k == right.k) & (right.e <= left.d), "left").groupBy("n").agg(F.max(F.struct("e", "m")).alias("x")).select("n", "x.m")
    assert sorted((r.n, r.last.m if r.last else None) for r in seen.collect()) == sorted((r.n, r.m) for r in plain.collect())


def test_fractional_diameters_in_any_order(make_study):
    tr = [("s", 1.0, f"T{i}", "LDIAM", "TARGET", v, "SCREENING") for i, v in enumerate((10.1, 10.1, 10.1))]
    tr += [("s", 2.0, "T0", "LDIAM", "TARGET", 21.21, "TREATMENT"), ("s", 3.0, "T0", "LDIAM", "TARGET", 25.452, "TREATMENT"), ("s", 4.0, "T0", "LDIAM", "TARGET", 25.451, "TREATMENT")]
    rs = [("s", v, float(v), "TARGET RESPONSE", t, a, x) for v, t, a, x in (
        (1.0, "SUMDIAM", "", 30.3), (2.0, "SUMDIAM", "", 21.210001), (2.0, "OVRESP", "SD", None), (3.0, "OVRESP", "SD", None), (4.0, "OVRESP", "PD", None))]
    for order in (1, -1):
        st = make_study(TR=("USUBJID string, VISITNUM double, TRLNKID string, TRTESTCD string, TRGRPID string, TRSTRESN double, EPOCH string", tr[::order]),
                        RS=("USUBJID string, VISITNUM double, RSSEQ double, RSCAT string, RSTESTCD string, RSORRES string, RSSTRESN double", rs))
        got = rows(run_checks(st, ["S1", "S3", "S4"]), "rule_id", "visit")
        # 30.3 is the sum; 21.21 is exactly 70% of it; 25.452 would be exactly 120% of 21.21, but under 5 mm more
        assert got == [("S1", "2.0"), ("S3", "2.0")]


def test_sketches_merge(spark):
    flags = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("run"), F.lit("A01").alias("rule_id"), (F.col("id") % 20_000).cast("string").alias("subject"))
    parts = flagsets.subject_sketches(flags, "rule_id", "run")
    merged = flagsets.estimated(flagsets.merged_sketches(parts, "rule_id")).first()
    whole = flagsets.estimated(flagsets.subject_sketches(flags, "rule_id")).first()
    assert merged == whole and merged.flags == 60_000 and abs(merged.subjects / 20_000 - 1) < 0.02


@pytest.mark.parametrize("name", ["M01", "M03", "M05", "M08"])
def test_mapping_with_hot_subjects_equals_plain(spark, monkeypatch, name):
    from crosswitness.catalog import job_queries
    from crosswitness.plans import mapping

    query, measured = job_queries.queries()[name], mapping._with_loads
    plain = sorted(map(str, query(spark, SF).collect()))
    monkeypatch.setattr(mapping, "_with_loads", lambda raw, config: measured(raw, config, 3))
    assert sorted(map(str, query(spark, SF).collect())) == plain
