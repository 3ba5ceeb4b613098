"""Quotient filters, collocations and Katz backoff: round trips, brute force, odd rows."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import DDL, LONG, SF, clashing, documents, same

from crosswitness.llm import collocations, katz, shards
from crosswitness.llm.shards import QuotientFilter


@pytest.mark.parametrize("bits,shard_bits,n", [(1, 0, 2), (6, 2, 40), (34, 3, 5000), (64, 4, 5000), (64, 0, 1)])
def test_quotient_filter_is_lossless(bits, shard_bits, n):
    rng = random.Random(bits)
    keys = [rng.randrange(2**bits) for _ in range(n)]
    keys += keys[: n // 3] * 5
    got = Counter()
    for s, f in QuotientFilter.of_shards(np.array(keys, np.uint64), bits, shard_bits):
        back = QuotientFilter.from_bytes(f.to_bytes())
        assert (np.diff(back.keys.astype(object)) > 0).all() and all(int(k) >> (bits - shard_bits) == s for k in back.keys if shard_bits)
        got.update({int(k): int(c) for k, c in zip(back.packed(), back.counts)})
    assert got == Counter(keys)


def test_merged_filters_add_up_and_are_compact():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2**34, 60_000).astype(np.uint64) % np.uint64(50_000) * np.uint64(340_001) for _ in range(2))
    (_, x), = QuotientFilter.of_shards(a, 34, 0)
    (_, y), = QuotientFilter.of_shards(b, 34, 0)
    m = QuotientFilter.merged([x, y])
    assert dict(zip(m.packed().tolist(), m.counts.tolist())) == Counter(a.tolist()) + Counter(b.tolist())
    assert len(m.to_bytes()) < 5 * len(m.keys)  # 34 bits and a counter each, in under five bytes


def test_packed_numbers():
    for a in (np.zeros(0, np.int64), np.array([0]), np.array([255, 256]), np.array([2**63 - 1, 0])):
        assert (shards.unpack_counts(shards.pack_counts(a)) == a).all()


def test_collocations_equal_sql(spark):
    same(collocations.op13_collocations(spark, "/root/testdata/sf0.01"), collocations.OP13_SQL, "/root/testdata/sf0.01")


def brute_phrases(rows, least, top, absorb=80):
    f, n = defaultdict(Counter), Counter()
    for part, text in rows:
        name = "und" if part is None else part
        piece = [[]]
        for ch in (text or ""):
            ch = ch.lower() if "A" <= ch <= "Z" else ch
            if ch in ".,;:!?\n\x0b\x0c\r":
                piece.append([])
            else:
                piece[-1].append(ch)
        for p in piece:
            w = [x for x in "".join(p).replace("\t", " ").split(" ") if x]
            n[name] += len(w)
            for m in range(1, 5):
                f[name].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for part, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= absorb * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((part, rank, p.decode(), -a, l, r, n[part], -s))
    return sorted(out)


def test_a_slice_without_a_frequent_pair_has_no_longer_phrases():
    nothing = shards.pack_counts(np.zeros(0, np.int64))
    streams = pd.DataFrame({"slice": [0], "data": [shards.pack_counts(np.array([1, 2, 3, 0]))]})
    answers = pd.DataFrame({"data": [nothing], "ids": [nothing]})
    assert not len(collocations._longer(2, 1, 0)(streams, answers))


def test_collocations_of_odd_rows_and_small_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_ENTRIES", 400)
    rng = random.Random(2)
    rows = [(rng.choice(["en", None, "", "ü"]), " ".join(rng.choice("a b c D. é,f ğ\tH i\x1fj").strip() or "z" for _ in range(rng.randint(0, 60)))) for _ in range(120)]
    rows += [("en", None), ("en", ""), (None, "Same same, SAME same same same"), ("en", "x y z w " * 500), ("fr", "...")]
    docs = clashing(spark.createDataFrame(rows, "lang string, text string")).repartition(5)
    got = collocations.collocations(docs.select("text", F.col("lang").alias("part")), str(tmp_path / "a"), least=3, top=7)
    want = brute_phrases(rows, 3, 7)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    none = collocations.collocations(docs.limit(0).select("text", F.col("lang").alias("part")), str(tmp_path / "b"))
    assert none.count() == 0


class BruteKatz:
    """Dictionaries and recursion, straight from the definition."""

    def __init__(self, texts, order):
        self.order, self.c, self.after = order, Counter(), defaultdict(set)
        for w in texts:
            w = [None, *w, None]
            for i in range(1, len(w)):
                for m in range(1, order + 1):
                    if i - m + 1 >= 0:
                        g = tuple(w[i - m + 1 : i + 1])
                        self.c[g] += 1
                        self.after[g[:-1]].add(g[-1])
        self.n = sum(v for g, v in self.c.items() if len(g) == 1)
        self.vocabulary = {g[0] for g in self.c if len(g) == 1}
        self.d = {m: katz.discounts([0.0, *[float(sum(len(g) == m and v == r for g, v in self.c.items())) for r in range(1, 7)]]) for m in range(1, order + 1)}
        self.memo = {}

    def disc(self, g):
        v = self.c[g]
        return v * (self.d[len(g)][v] if v <= 5 else 1)

    def history(self, h):
        """(denominator, what is left for unseen words)"""
        key = ("history", h)
        if key not in self.memo:
            total = sum(self.c[h + (w,)] for w in self.after[h])
            left = sum(self.c[h + (w,)] - self.disc(h + (w,)) for w in self.after[h])
            self.memo[key] = (total, left / total) if left > 0 else (total + 1, 1 / (total + 1))
        return self.memo[key]

    def p(self, h, w):
        if (h, w) not in self.memo:
            self.memo[h, w] = self._p(h, w)
        return self.memo[h, w]

    def _p(self, h, w):
        if not h:
            den, left = self.history(())
            return self.disc((w,)) / den if self.c[(w,)] else left
        if not self.after.get(h):
            return self.p(h[1:], w)
        den, left = self.history(h)
        if self.c[h + (w,)]:
            return self.disc(h + (w,)) / den
        key = ("alpha", h)
        if key not in self.memo:
            self.memo[key] = left / (1 - sum(self.p(h[1:], x) for x in self.after[h]))
        return self.memo[key] * self.p(h[1:], w)

    def score(self, words):
        w, total = [None, *words, None], 0.0
        for i in range(1, len(w)):
            total += math.log10(self.p(tuple(w[max(0, i - self.order + 1) : i]), w[i]))
        return total


def lowered(text):
    return (text or "").encode().translate(shards.LOWER).split()


def check_scores(got, rows, order):
    train = [lowered(t) for d, t, counted in rows if counted]
    model = BruteKatz(train, order)
    want = []
    for d, t, counted in rows:
        w = lowered(t)
        v = len(model.vocabulary)
        base = sum(math.log10((model.c[(x,)] + 1) / (model.n + v + 1)) for x in [*w, None])
        known = sum(model.c[(x,)] > 0 for x in [*w, None])
        want.append((d, counted, len(w) + 1, known, model.n, base, model.score(w)))
    key = lambda r: (str(r[0]), r[1], r[2], r[5])
    got = sorted(map(tuple, got.collect()), key=key)
    want.sort(key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)
    return model


@pytest.mark.parametrize("order", [1, 3, 4])
def test_katz_equals_brute_force(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(katz, "SHARD_ENTRIES", 500)
    monkeypatch.setattr(katz, "HOT", 15)
    rng = random.Random(order)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40))), i % 5 != 0) for i in range(90)]
    rows += [(90, "New unseen WORDS w1", False), (91, None, True), (92, "", False), (None, "w1 w2\tw3\x0bW1", True), (93, rows[1][1], True), (93, rows[1][1], True)]
    rows.append((94, "w0 w0 w1 " * 300, True))
    docs = spark.createDataFrame(rows, "doc_id long, text string, counted boolean").repartition(3)
    model = check_scores(katz.scores(docs, str(tmp_path / "m"), order), rows, order)
    # Each history sums to one over the vocabulary and the one unknown outcome.
    outcomes = [*model.vocabulary, b"never seen"]
    for h in [(), *[g[-(order - 1):] for g in list(model.c)[::97] if order > 1 and len(g) == order and None not in g[1:]]]:
        assert abs(sum(model.p(h, w) for w in outcomes) - 1) < 1e-9


def test_katz_query_equals_brute_force(spark):
    rows = [(d, t, zlib.crc32(str(d).encode()) % 7 != 2) for d, t in documents()]
    got = katz.op12_katz(spark, SF).withColumn("counted", ~F.col("held_out")).select("doc_id", "counted", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    check_scores(got, rows, katz.ORDER)
    held = [r for r in got.collect() if not r.counted]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_odd_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, counted boolean")
    assert katz.scores(empty, str(tmp_path / "a")).count() == 0
    none = spark.createDataFrame([(1, "a b", False), (2, None, False)], "doc_id long, text string, counted boolean")
    assert {(r.doc_id, r.n_known, r.train_tokens, r.base_score, r.score) for r in katz.scores(none, str(tmp_path / "b")).collect()} == {(1, 0, 0, 0.0, 0.0), (2, 0, 0, 0.0, 0.0)}
    odd = clashing(spark.createDataFrame([(None, LONG, "en", "s", 1), (2**60 + 1, LONG.upper(), None, None, None)], DDL)).withColumn("counted", F.lit(True))
    assert {r.doc_id for r in katz.scores(odd, str(tmp_path / "c")).collect()} == {None, 2**60 + 1}


def test_discounts_are_valid_for_any_counts_of_counts():
    for n in ([0.0] * 7, [0, 5, 9, 0, 0, 0, 0], [0, 100, 50, 25, 12, 6, 3], [0, 1, 100, 1, 1, 1, 1], [0, 9e6, 2e6, 9e5, 5e5, 3e5, 2e5]):
        d = katz.discounts([float(x) for x in n])
        assert d[0] == 0 and ((d[1:] > 0) & (d[1:] < 1)).all()
