"""Set algebra and metrics: flags of the checks, and flag sets derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from crosswitness.catalog.check_queries import ALL, FLAT, flags_cte
from crosswitness.catalog.testbed import PRELUDE, study, table
from crosswitness.plans import flagsets as fs
from crosswitness.plans.checks import run_checks
from crosswitness.sources.staging import required_root, written

SOURCES = ["B1", "B2", "B3"]
EVENT_FLAGS = """WITH ef AS (
  SELECT concat('U', CAST(user_id AS VARCHAR)) AS subject, event_type AS rule_id, event_id,
         CASE event_id % 3 WHEN 0 THEN 'B1' WHEN 1 THEN 'B2' ELSE 'B3' END AS source,
         CASE WHEN value < 10 THEN 'warning' ELSE 'violation' END AS severity FROM events),
pr AS (SELECT DISTINCT subject, rule_id, source FROM ef),
a AS (SELECT DISTINCT subject, rule_id FROM ef WHERE source = 'B1'),
b AS (SELECT DISTINCT subject, rule_id FROM ef WHERE source = 'B2')
"""


def event_flags(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("rule_id"),
        "event_id", F.element_at(F.array(*map(F.lit, SOURCES)), (F.col("event_id") % 3 + 1).cast("int")).alias("source"),
        F.when(F.col("value") < 10, "warning").otherwise("violation").alias("severity"))


def _two(spark, sf):
    f = event_flags(spark, sf)
    return f.filter("source = 'B1'"), f.filter("source = 'B2'")


def _checks(spark, sf, ids=ALL):
    return run_checks(study(spark, sf), ids)


def _labels(spark, sf):
    return table(spark, sf, "labels").select(
        (F.col("doc_id") % 40).alias("grp"), (F.col("quality") == 1).alias("ours"), (F.col("toxic") == 1).alias("theirs"))


LABELS = "WITH lb AS (SELECT doc_id % 40 AS grp, quality = 1 AS ours, toxic = 1 AS theirs FROM labels)\n"
RATINGS = """WITH votes AS (SELECT doc_id, (quality + toxic * r + doc_id % (r + 2)) % 3 AS vote FROM labels, range(3) t(r)),
ratings AS (SELECT doc_id, count_if(vote = 0) AS valid, count_if(vote = 1) AS invalid, count_if(vote = 2) AS uncertain
            FROM votes GROUP BY doc_id)
"""


def _ratings(spark, sf):
    r = F.col("r")
    votes = table(spark, sf, "labels").withColumn("r", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn(
        "vote", (F.col("quality") + F.col("toxic") * r + F.col("doc_id") % (r + 2)) % 3)
    return votes.groupBy("doc_id").agg(*[F.count_if(F.col("vote") == i).alias(n) for i, n in enumerate(("valid", "invalid", "uncertain"))])


def _sketched(spark, sf):
    """Sketches per rule and source are stored and merged over the sources; the estimate is held against the exact count."""
    flags = event_flags(spark, sf)
    stored = written(fs.subject_sketches(flags, "rule_id", "source"), f"{required_root(spark)}/sketches")
    about = fs.estimated(fs.merged_sketches(stored, "rule_id")).withColumnRenamed("subjects", "_about")
    exact = flags.groupBy("rule_id").agg(F.countDistinct("subject").alias("subjects"))
    return about.join(exact, "rule_id").select("rule_id", "flags", "subjects", (F.abs(F.col("_about") - F.col("subjects")) <= F.greatest(F.lit(1), F.col("subjects") * 0.03)).alias("close"))


# -- adjudication inputs: part names stand for archetypes, suppliers for rules -----------
ADJ = """WITH cls AS (SELECT n_name AS archetype, CASE WHEN n_regionkey < 2 THEN 'recist_semantic' ELSE 'structural_consistency' END AS category,
    concat('R', CAST((n_nationkey * 7) % 25 AS VARCHAR)) AS matched_rule,
    CASE n_nationkey % 3 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' ELSE 'none' END AS confidence FROM nation),
iss AS (SELECT n.n_name AS archetype, concat('R', CAST(o.o_orderkey % 25 AS VARCHAR)) AS rule_id FROM orders o
    JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey),
adj AS (SELECT k.archetype, k.category, (SELECT count(*) FROM iss i WHERE i.archetype = k.archetype) AS new_issues,
    EXISTS (SELECT 1 FROM iss i WHERE i.archetype = k.archetype AND i.rule_id = k.matched_rule) AS fired, k.confidence FROM cls k)
"""


def _adjudicated(spark, sf):
    key = F.col("n_nationkey")
    nation = table(spark, sf, "nation")
    cls = nation.select(
        F.col("n_name").alias("archetype"),
        F.when(F.col("n_regionkey") < 2, "recist_semantic").otherwise("structural_consistency").alias("category"),
        F.concat(F.lit("R"), (key * 7 % 25).cast("string")).alias("matched_rule"),
        F.when(key % 3 == 0, "direct").when(key % 3 == 1, "indirect").otherwise("none").alias("confidence"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    issues = (orders.join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
              .join(nation, "n_nationkey")
              .select(F.col("n_name").alias("archetype"), F.concat(F.lit("R"), (F.col("o_orderkey") % 25).cast("string")).alias("rule_id")))
    return fs.adjudicate(issues, cls)


def queries() -> dict:
    q = {}
    q["U01"] = lambda s, d: fs.union_flags(_checks(s, d, ["A06", "A09"]), _checks(s, d, ["A18"])).select(*FLAT)
    q["U02"] = lambda s, d: fs.only_in(*_two(s, d)).select("subject", "rule_id", "event_id")
    q["U03"] = lambda s, d: fs.jaccard(*_two(s, d))
    q["U04"] = lambda s, d: fs.pairs(fs.only_in(_checks(s, d, ["A18"]), _checks(s, d, ["A06"]), ("subject", "visit")), ("subject", "visit"))
    q["EV01"] = lambda s, d: fs.jaccard_matrix(event_flags(s, d), SOURCES)
    q["EV02"] = lambda s, d: fs.recall_by_rule(*_two(s, d))
    q["EV03"] = lambda s, d: fs.regression_report(*_two(s, d))
    q["EV04"] = lambda s, d: fs.novelty_report(*_two(s, d))
    q["EV11"] = lambda s, d: fs.adjudication_summary(_adjudicated(s, d))
    q["EV12"] = lambda s, d: fs.mcnemar(_labels(s, d), F.col("ours"), F.col("theirs"), ["grp"])
    q["EV13"] = lambda s, d: (_labels(s, d).groupBy("grp").agg(F.count_if("ours").alias("k"), F.count(F.lit(1)).alias("n"))
                              .withColumn("ci", fs.rate_interval(F.col("k"), F.col("n"))).select("grp", "k", "n", "ci.low", "ci.high"))
    q["EV14"] = lambda s, d: fs.bootstrap_rate(
        _labels(s, d).groupBy("grp").agg(F.bool_or("theirs").alias("any"), F.bool_and("ours").alias("all")), F.col("all") | ~F.col("any"))
    q["EV15"] = lambda s, d: (_labels(s, d).groupBy("grp").agg(
        F.count_if(F.col("ours") & F.col("theirs")).alias("tp"), F.count_if(F.col("ours") & ~F.col("theirs")).alias("fp"),
        F.count_if(~F.col("ours") & F.col("theirs")).alias("fn"))
        .withColumn("m", fs.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))).select("grp", "tp", "fp", "fn", "m.*"))
    q["EV16"] = lambda s, d: fs.fleiss_kappa(_ratings(s, d), ["valid", "invalid", "uncertain"]).withColumn(
        "label", fs.kappa_label(F.col("kappa")))
    q["EV18"] = lambda s, d: _checks(s, d).agg(F.count_if(F.col("archetype").startswith("A")).alias("archetype_flags"))
    q["EV20"] = lambda s, d: fs.detection_matrix(
        event_flags(s, d).select(F.col("rule_id").alias("archetype"), "source", (F.col("severity") == "warning").alias("detected")), SOURCES)
    q["AG06"] = lambda s, d: fs.summary(_checks(s, d), "rule_id", "domain", "severity")
    q["AG07-SKETCH"] = _sketched
    q["AG07"] = lambda s, d: fs.summary(_checks(s, d).filter(F.col("archetype").startswith("A")), "archetype")
    q["AG11"] = lambda s, d: fs.union_flags(_checks(s, d)).groupBy(fs.family(F.col("rule_id")).alias("family")).agg(F.count(F.lit(1)).alias("flags"))
    q["AG12"] = lambda s, d: fs.consensus(event_flags(s, d).select("subject", F.col("rule_id").alias("verdict")), "subject", "verdict")
    return q


def oracle() -> dict:
    flat = ", ".join(FLAT)
    o = {}
    o["U01"] = PRELUDE + flags_cte(["A06", "A09", "A18"]) + f"SELECT {flat} FROM flags"
    o["U02"] = EVENT_FLAGS + "SELECT subject, rule_id, event_id FROM ef WHERE source = 'B1' AND (subject, rule_id) NOT IN (SELECT (subject, rule_id) FROM b)"
    sizes = """(SELECT count(*) FROM a) AS left_pairs, (SELECT count(*) FROM b) AS right_pairs,
      (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS overlap,
      (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS union_pairs"""
    o["U03"] = EVENT_FLAGS + f"SELECT *, overlap / union_pairs AS jaccard FROM (SELECT {sizes})"
    o["U04"] = (PRELUDE + flags_cte(["A06", "A18"]) +
                "SELECT DISTINCT subject, visit FROM flags WHERE rule_id = 'A18' EXCEPT SELECT subject, visit FROM flags WHERE rule_id = 'A06'")
    o["EV01"] = EVENT_FLAGS + """, src AS (SELECT DISTINCT source FROM ef)
      SELECT *, overlap / union_pairs AS jaccard FROM (SELECT x.source AS left_source, y.source AS right_source,
        (SELECT count(*) FROM (SELECT subject, rule_id FROM pr WHERE source = x.source INTERSECT SELECT subject, rule_id FROM pr WHERE source = y.source)) AS overlap,
        (SELECT count(*) FROM (SELECT subject, rule_id FROM pr WHERE source = x.source UNION SELECT subject, rule_id FROM pr WHERE source = y.source)) AS union_pairs
      FROM src x, src y)"""
    o["EV02"] = EVENT_FLAGS + """SELECT rule_id, count(*) AS gold_pairs, count_if(hit) AS found, count_if(hit) / count(*) AS recall
      FROM (SELECT b.*, EXISTS (SELECT 1 FROM a WHERE a.subject = b.subject AND a.rule_id = b.rule_id) AS hit FROM b) GROUP BY rule_id"""
    o["EV03"] = EVENT_FLAGS + f"""SELECT 'A' AS track, round(overlap / union_pairs, 4) AS jaccard, overlap, overlap / union_pairs >= 0.95 AS pass_threshold,
      (SELECT count(*) FROM ef WHERE source = 'B1') AS l1_flags, (SELECT count(*) FROM ef WHERE source = 'B2') AS core_flags FROM (SELECT {sizes})"""
    o["EV04"] = EVENT_FLAGS + """SELECT 'B' AS track, n AS our_flags, m AS core_flags, k AS only_ours, k > 0 AS has_novelty FROM (SELECT
      (SELECT count(*) FROM ef WHERE source = 'B1') AS n, (SELECT count(*) FROM ef WHERE source = 'B2') AS m,
      (SELECT count(*) FROM ef WHERE source = 'B1' AND (subject, rule_id) NOT IN (SELECT (subject, rule_id) FROM b)) AS k)"""
    o["EV11"] = ADJ + """SELECT category, count(*) AS archetypes, count_if(new_issues > 0) AS flagged,
      count_if(fired AND confidence = 'direct') AS direct, count_if(fired AND confidence = 'indirect') AS indirect FROM adj GROUP BY category"""
    o["EV12"] = LABELS + """SELECT grp, b, c, CASE WHEN b + c = 0 THEN 1.0 ELSE round(round(least(1.0, 2 * list_sum(list_transform(range(least(b, c)::BIGINT + 1),
      lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))), 12), 6) END AS p_value
      FROM (SELECT grp, count_if(ours AND NOT theirs) AS b, count_if(NOT ours AND theirs) AS c FROM lb GROUP BY grp)"""
    o["EV13"] = LABELS + """, t AS (SELECT grp, count_if(ours) AS k, count(*) AS n, greatest(count(*) - 1, 1)::DOUBLE AS m FROM lb GROUP BY grp),
      w AS (SELECT *, CASE WHEN n > 1 THEN (k - 1) / m ELSE 0 END AS pl, CASE WHEN n > 1 THEN k / m ELSE 0 END AS ph FROM t)
      SELECT grp, k, n,
        CASE WHEN k = 0 THEN 0.0 ELSE round((pl + 3.8416 / (2 * m) - 1.96 * sqrt(greatest(pl * (1 - pl) / m + 3.8416 / (4 * m * m), 0.0))) / (1 + 3.8416 / m), 4) END AS low,
        CASE WHEN k = n THEN 1.0 ELSE round((ph + 3.8416 / (2 * m) + 1.96 * sqrt(greatest(ph * (1 - ph) / m + 3.8416 / (4 * m * m), 0.0))) / (1 + 3.8416 / m), 4) END AS high
      FROM w"""
    o["EV14"] = LABELS + """, it AS (SELECT bool_and(ours) OR NOT bool_or(theirs) AS hit FROM lb GROUP BY grp),
      t AS (SELECT count(*) AS n, count_if(hit) AS k FROM it),
      d AS (SELECT rep, avg(CASE WHEN ('0x' || substr(md5(concat('42-', rep, '-', i)), 1, 8))::BIGINT / 4294967296.0 * n < k THEN 1.0 ELSE 0.0 END) AS rate
            FROM t, range(1000) r(rep), range(1, 10000) s(i) WHERE i <= n GROUP BY rep),
      z AS (SELECT list_sort(list(rate)) AS r, list_sort(list(CASE WHEN rate > 0 THEN 2 * rate / (1 + rate) ELSE 0 END)) AS f FROM d)
      SELECT 1000 AS reps, round(r[26], 4) AS rate_low, round(r[975], 4) AS rate_high, round(f[26], 4) AS f1_low, round(f[975], 4) AS f1_high FROM z"""
    o["EV15"] = LABELS + """SELECT grp, tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM (
      SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r FROM (
      SELECT grp, count_if(ours AND theirs) AS tp, count_if(ours AND NOT theirs) AS fp, count_if(NOT ours AND theirs) AS fn FROM lb GROUP BY grp))"""
    o["EV16"] = RATINGS + """, s AS (SELECT count(*) AS items, CAST(3 AS BIGINT) AS raters, avg((valid * valid + invalid * invalid + uncertain * uncertain - 3) / 6.0) AS pbar,
        pow(sum(valid) / (count(*) * 3.0), 2) + pow(sum(invalid) / (count(*) * 3.0), 2) + pow(sum(uncertain) / (count(*) * 3.0), 2) AS pe,
        count_if(valid = 3) AS unanimous_valid, count_if(valid > 1.5) AS majority_valid, count_if(invalid > 0) AS any_invalid,
        count_if(uncertain > 1.5) AS majority_uncertain FROM ratings)
      SELECT items, raters, round((pbar - pe) / (1 - pe), 4) AS kappa, unanimous_valid, majority_valid, any_invalid, majority_uncertain,
        CASE WHEN (pbar - pe) / (1 - pe) < 0 THEN 'Poor' WHEN (pbar - pe) / (1 - pe) < 0.21 THEN 'Slight' ELSE 'Fair' END AS label FROM s"""
    o["EV18"] = PRELUDE + flags_cte() + "SELECT count_if(starts_with(archetype, 'A')) AS archetype_flags FROM flags"
    o["EV20"] = EVENT_FLAGS + "SELECT rule_id AS archetype, " + ", ".join(
        f"max(CASE WHEN source = '{s}' AND severity = 'warning' THEN 1 ELSE 0 END) AS {s}" for s in SOURCES) + " FROM ef GROUP BY rule_id"
    o["AG06"] = PRELUDE + flags_cte() + "SELECT rule_id, domain, severity, count(*) AS flags, count(DISTINCT subject) AS subjects FROM flags GROUP BY ALL"
    o["AG07-SKETCH"] = EVENT_FLAGS + "SELECT rule_id, count(*) AS flags, count(DISTINCT subject) AS subjects, TRUE AS close FROM ef GROUP BY rule_id"
    o["AG07"] = PRELUDE + flags_cte() + "SELECT archetype, count(*) AS flags, count(DISTINCT subject) AS subjects FROM flags WHERE archetype LIKE 'A%' GROUP BY ALL"
    o["AG11"] = PRELUDE + flags_cte() + "SELECT CASE WHEN rule_id LIKE 'S%' THEN 'derivation' ELSE 'archetype' END AS family, count(*) AS flags FROM flags GROUP BY ALL"
    o["AG12"] = EVENT_FLAGS + """, n AS (SELECT subject, rule_id, count(*) AS c FROM ef WHERE rule_id <> 'error' GROUP BY ALL)
      SELECT subject, (SELECT rule_id FROM n x WHERE x.subject = n.subject ORDER BY c DESC, rule_id LIMIT 1) AS consensus,
        round(max(c) / sum(c), 3) AS agreement_rate FROM n GROUP BY subject"""
    return o
