"""Inject-and-detect experiments over the derived study."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from crosswitness.catalog.check_queries import TRV, LOOKUP_SQL, check_sql
from crosswitness.catalog.testbed import PRELUDE, study
from crosswitness.catalog import injected_sql as sq
from crosswitness.plans import detect
from crosswitness.plans import differential as df
from crosswitness.plans.checks import ARCHETYPES, run_checks
from crosswitness.plans.inject import compatible_set, inject

Q: dict = {}
O: dict = {}
def query(name: str, sql: str = "", prelude: str = PRELUDE):
    def add(fn):
        Q[name] = fn
        if sql:
            O[name] = prelude + sql
        return fn
    return add


EV05_SQL = sq.flag_sets(df.LOCAL) + sq.stored(sq.ARM) + f""", aff(injected, archetype) AS (VALUES {', '.join(f"('{a}', '{c}')" for a in df.LOCAL for c in df.affected(a))})
  SELECT injected AS archetype, CAST(sum(n) AS BIGINT) AS flag_delta, sum(n) <> 0 AS detected FROM (SELECT injected, n FROM now UNION ALL SELECT injected, 0 FROM tried
    UNION ALL SELECT aff.injected, -was.n FROM was JOIN aff USING (archetype) JOIN tried t ON t.injected = aff.injected AND t.subject = was.subject
    UNION ALL SELECT 'A17', d FROM each17) GROUP BY injected"""


@query("EV05", EV05_SQL, "")
def _(spark, sf):
    return df.flag_deltas(study(spark, sf))


@query("EV06", sq.flag_sets(df.LOCAL, own_only=True) + sq.stored(sq.ARM) + f""", noise AS (SELECT archetype, count(DISTINCT subject) AS c FROM (SELECT subject, archetype FROM was
    UNION ALL SELECT USUBJID, 'A17' FROM arm17) GROUP BY archetype)
  SELECT a AS archetype, a IN (SELECT injected FROM now) OR (a = 'A17' AND (SELECT bool_or(hit) FROM each17)) AS detected, coalesce(c, 0) AS clean_fp_subjects
  FROM (SELECT DISTINCT injected AS a FROM tried UNION SELECT 'A17' FROM each17) LEFT JOIN noise ON noise.archetype = a""", "")
def _(spark, sf):
    return df.single_pass(study(spark, sf))


@query("EV07", sq.all_verdicts_sql("SELECT * FROM vs"), "")
def _(spark, sf):
    return df.all_verdicts(study(spark, sf))


@query("EV07-V", sq.flag_sets(("VA07", "VA20"), own_only=True) + f"SELECT *, {sq.STATUS} FROM ({sq.verdict_rows(('VA07', 'VA20'))})", "")
def _(spark, sf):
    # the injections that do not depend on the visit schedule, judged by the checks of their archetypes
    return df.verdicts(study(spark, sf), ("VA07", "VA20"))


DM1 = """, fa AS (SELECT USUBJID FROM dm t WHERE EXISTS (SELECT 1 FROM dm x WHERE x.ARMCD = t.ARMCD AND x.ARM <> t.ARM)),
  one AS (SELECT min(USUBJID) AS s FROM dm WHERE USUBJID NOT IN (FROM fa)), peer AS (SELECT coalesce((SELECT min(o.USUBJID) FROM dm o WHERE o.USUBJID <> s AND o.ARMCD = (SELECT arg_min(ARMCD, STUDYID) FROM dm WHERE USUBJID = s)), s) AS p FROM one),
  dm2 AS (SELECT STUDYID, USUBJID, ARMCD, CASE WHEN USUBJID = (SELECT p FROM peer) THEN 'CONFLICTING ARM NAME' ELSE ARM END AS ARM FROM dm),
  fb AS (SELECT USUBJID FROM dm2 t WHERE EXISTS (SELECT 1 FROM dm2 x WHERE x.ARMCD = t.ARMCD AND x.ARM <> t.ARM)),
  r AS (SELECT (SELECT count(*) FROM fb) - (SELECT count(*) FROM fa) AS total_flag_delta,
    (SELECT count(DISTINCT USUBJID) FROM fb WHERE USUBJID NOT IN (FROM fa)) AS newly_flagged_subjects)
  SELECT 'A17' AS archetype, total_flag_delta, newly_flagged_subjects, CASE WHEN newly_flagged_subjects > 0 THEN 'detected' ELSE 'missed' END AS status FROM r"""


@query("EV08", DM1)
def _(spark, sf):
    st = study(spark, sf)
    free = detect.candidates(st, run_checks(st, ["A17"]), ("A17",), 1)
    return detect.cohort_detection(st, "A17", free.select("USUBJID"))


@query("EV08-A16", """, r AS (SELECT (SELECT count(*) FROM dm WHERE USUBJID IN (SELECT USUBJID FROM dm GROUP BY 1 HAVING count(*) > 1)) AS b,
    (SELECT count(*) + (SELECT count(DISTINCT USUBJID) FROM dm) FROM dm) AS a, (SELECT count(*) FROM (SELECT USUBJID FROM dm GROUP BY 1 HAVING count(*) = 1)) AS n)
  SELECT 'A16' AS archetype, a - b AS total_flag_delta, n AS newly_flagged_subjects, 'detected' AS status FROM r""")
def _(spark, sf):
    st = study(spark, sf)
    return detect.cohort_detection(st, "A16", st["DM"].select("USUBJID").distinct())


HELD_OUT = ("H01", "H02", "H03", "H04", "H05")


@query("EV09", sq.flag_sets(HELD_OUT) + f""", aff(injected, archetype) AS (VALUES {', '.join(f"('{a}', '{c}')" for a in HELD_OUT for c in df.affected(a))}),
  fresh_flags AS (SELECT injected, subject, archetype FROM now WHERE (subject, archetype) NOT IN (SELECT (subject, archetype) FROM was)),
  d AS (SELECT injected, CAST(sum(n) AS BIGINT) AS flag_delta FROM (SELECT injected, n FROM now UNION ALL SELECT injected, 0 FROM tried
    UNION ALL SELECT aff.injected, -was.n FROM was JOIN aff USING (archetype) JOIN tried t ON t.injected = aff.injected AND t.subject = was.subject) GROUP BY injected)
  SELECT injected AS archetype, (SELECT count(*) FROM tried t WHERE t.injected = d.injected) AS candidates_tried,
    (SELECT count(DISTINCT subject) FROM fresh_flags f WHERE f.injected = d.injected) AS subjects_with_new_flags,
    coalesce((SELECT string_agg(DISTINCT archetype, ',' ORDER BY archetype) FROM fresh_flags f WHERE f.injected = d.injected), '') AS new_checks,
    flag_delta, EXISTS (SELECT 1 FROM fresh_flags f WHERE f.injected = d.injected) AS detected FROM d""", "")
def _(spark, sf):
    st = study(spark, sf)
    return df.held_out(st, HELD_OUT, st["DM"].select("USUBJID"))


@query("EV10", sq.all_verdicts_sql("""SELECT count_if(status IN ('detected', 'missed')) AS applicable, count_if(status = 'detected') AS detected,
  coalesce(string_agg(archetype, ',' ORDER BY archetype) FILTER (WHERE status = 'detected'), '') AS detected_ids,
  coalesce(string_agg(archetype, ',' ORDER BY archetype) FILTER (WHERE status = 'missed'), '') AS missed_ids, '' AS na_ids,
  count_if(status = 'detected') / count_if(status IN ('detected', 'missed')) AS recall FROM vs"""), "")
def _(spark, sf):
    return df.recall(study(spark, sf))


@query("EV17")
def _(spark, sf):
    return df.robustness(study(spark, sf))


@query("EV17-SUM")
def _(spark, sf):
    return df.stability(df.robustness(study(spark, sf)))


@query("EV17-CO")
def _(spark, sf):
    st = study(spark, sf)
    alone = tuple(a for a in ARCHETYPES if a not in ("A16", "A17", "A19"))
    before = df.clean_counts(st, alone)
    plan = detect.candidates(st, before, alone)
    new = df.experiment(st, plan, alone, alone, own_only=True, before=before).newly_flagged().filter("archetype = injected")
    fires = new.select(F.col("subject").alias("USUBJID"), "archetype").distinct()
    return detect.co_occurrence(st, compatible_set(fires, ["USUBJID"]), fires, alone)


# Injections that change two tables, or two columns, compared as a whole.
def _every_table(archetype, tables):
    def run(spark, sf):
        st = study(spark, sf)
        changed, _ = inject(st, archetype, st["DM"].select("USUBJID"))
        cell = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
        return reduce(lambda x, y: x.unionByName(y), [changed[d].select(F.lit(d).alias("domain"), "USUBJID", *[
            cell(c, "double" if i < 2 else "string").alias(n) for i, (c, n) in enumerate(zip(sq.SHOWN[d], ("n1", "n2", "t1", "t2")))]) for d in tables])
    return run


for _a, _tables in (("A04", ("RS", "TR")), ("A06", ("RS", "TR")), ("A09", ("DS", "RELREC")), ("A14", ("EX", "RELREC")), ("A18", ("RS", "TR")),
                    ("H01", ("RS", "TU")), ("H03", ("RS", "TR")), ("H04", ("RS", "TR")), ("H05", ("DM",))):
    Q[f"INJ-{_a}-ALL"] = _every_table(_a, _tables)
    O[f"INJ-{_a}-ALL"] = sq.every_table(_a, _tables)


# The whole loop for one archetype, over every subject, has a short closed form in SQL.
@query("EV07-A08", TRV + LOOKUP_SQL + f""", was AS ({check_sql('A08')}), free AS (SELECT DISTINCT USUBJID FROM dm WHERE USUBJID NOT IN (SELECT subject FROM was))
  SELECT 'A08' AS archetype, count(*) AS candidates_tried, count(*) AS candidates_detected, min(USUBJID) AS first_detected, 'detected' AS status FROM free""")
def _(spark, sf):
    return detect.candidate_detection(study(spark, sf), ("A08",), k=None)


def queries() -> dict:
    return Q


def oracle() -> dict:
    return O
