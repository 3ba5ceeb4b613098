"""Periodic runs against a brute-force version, on planted texts, the query's tables and edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_operators import DDL, LONG, SF, clashing, documents

from crosswitness.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=24, times=3):
    """Every lag, every stretch; the smallest period is looked for among all shorter ones."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, times * q) and not any(w[s : e - p] == w[s + p : e] for p in range(1, q)):
                out.append((s, e - s, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng, hits = random.Random(5), 0
    for _ in range(1500):
        w = [b"%d" % rng.randrange(rng.choice((1, 2, 3, 90))) for _ in range(rng.randint(20, 160))]
        for _ in range(rng.randint(0, 3)):
            at, p = rng.randrange(len(w)), rng.randint(1, 20)
            for i in range(at + p, min(len(w), at + rng.randint(10, 100))):
                w[i] = w[i - p]
        assert pr.runs_of(w) == brute(w)
        hits += len(brute(w))
    assert hits > 500


def test_other_parameters_and_a_very_long_text():
    w = [b"a", b"b"] * 5 + [b"c"] * 4
    assert pr.runs_of(w, 4, 2) == brute(w, 4, 2) == [(0, 10, 2), (10, 4, 1)]
    assert pr.runs_of([b"x"] * 100_000) == [(0, 100_000, 1)]
    block = [b"%d" % i for i in range(9_000)]
    assert pr.runs_of([b"z"] + block * 3 + [b"0", b"y"]) == [(1, 27_001, 9_000)]


def test_nested_frequencies_split_down():
    """Frequent in the text, rare in every segment: nothing survives."""
    w = [b"%d" % (i % 40) if i % 7 else b"rare%d" % (i // 14) for i in range(2_000)]
    assert pr.split(pr.np.unique(w, return_inverse=True)[1], 24, 3) == []


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_query_equals_brute_force(spark):
    got = sorted(map(tuple, pr.op11_periodic_runs(spark, SF).collect()))
    want = sorted(expected(*d) for d in documents())
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10


def test_edges(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "a b " * 20, None, None, None), (3, "x\x1fy\xa0z " * 30, "en", "s", 1),
            (3, "x\x1fy\xa0z " * 30, "en", "s", 1), (4, LONG, "en", "s", 1), (5, "\t\n\x0b\x0c\r", "en", "s", 1)]
    docs = clashing(spark.createDataFrame(rows, DDL)).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("c"))
    got = pr.without_repetitions(docs)
    assert got.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in got.collect() if r.doc_id != 4]
    assert sorted(texts, key=str) == sorted(
        [(1, None), (2, ""), (None, "a b"), (3, "x\x1fy\xa0z"), (3, "x\x1fy\xa0z"), (5, "\t\n\x0b\x0c\r")], key=str)
    assert pr.without_repetitions(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text,doc_id", [(None, 1), ("", 2), ("one", 3), ("a  b\nc" * 9, None)])
def test_altered_texts_of_odd_rows(spark, text, doc_id):
    got = spark.createDataFrame([(doc_id, text)], "doc_id long, text string").select(pr.altered(F.col("text"), F.col("doc_id")).alias("t")).first().t
    if text is None:
        assert got is None
    else:
        assert len(WORD.findall(got)) == len(WORD.findall(text))
