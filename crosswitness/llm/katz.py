"""Language-model scores by Katz backoff: Good-Turing discounts, exactly normalised backoff weights.

P(w | h) = d(c) * c(hw) / c(h) where the n-gram hw was seen in training, else alpha(h) * P(w | h'),
with h' the history without its first word; alpha(h) = (what the discounts of h leave) / (1 - sum of
P(w | h') over the words seen after h), so every history sums to one.  Counts of up to ``RARE`` are
discounted by Good-Turing; where the counts of counts give no valid discount, they are smoothed by
a power law first.  A history without any rare count keeps one count for unseen words.  The words
that training lacks are together one outcome at the bottom, so probabilities sum to one over the
vocabulary and that outcome; a history that training lacks is skipped.

A text starts after an end token and closes with one.  Texts are worked on in slices (see
:mod:`shards`).  For every length a slice asks each shard once for its distinct n-grams, sending
its training counts along; the shard sums the counts, stores them as its part of the n-gram table
(``level-k/kind=ngrams`` under the path), and tells each slice the totals, and per history
what its backoff weight needs.  Shards go by history; the n-grams of a history that holds over
1 / ``HOT`` of all tokens are dealt over all shards, and the partial sums of those histories, at
most ``HOT``, are added up and sent along.

Defined results: null and empty texts have the end token only; a null id is in fold 0 and thus a
training text; repeated rows count and are scored each; without training texts everything is
the one unknown outcome (score 0); an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.llm import shards
from crosswitness.llm.common import only, table, work_folder
from crosswitness.llm.labels import fold
from crosswitness.llm.shards import LOWER, pack, pack_counts, unpack, unpack_counts
from crosswitness.llm.textops import mix

ORDER, RARE, HOT = 2, 5, 1000
SHARD_ENTRIES = 2_000_000

_U = np.uint64
_STEP = "kind string, slice long, level int, shard int, a binary, b binary, c binary, d binary, e binary, numbers array<double>"
_NAMES = [f.split()[0] for f in _STEP.split(", ")]
SCORES = "doc_id long, counted boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens_of(data: bytes) -> list[bytes]:
    out = data.translate(LOWER).split()  # exactly the blanks \x20 and \x09 to \x0D
    out.append(shards.END)
    return out


def discounts(n: list[float]) -> np.ndarray:
    """Factors for counts 0 to ``RARE`` from the counts of counts n[1], n[2], ...; larger counts keep 1."""
    def katz(m) -> np.ndarray | None:
        if not all(m[r] > 0 for r in range(1, RARE + 2)):
            return None
        cut = (RARE + 1) * m[RARE + 1] / m[1]
        if cut >= 1:
            return None
        d = np.array([((r + 1) * m[r + 1] / (r * m[r]) - cut) / (1 - cut) for r in range(1, RARE + 1)])
        return d if ((d > 0) & (d < 1)).all() else None

    d = katz(n)
    if d is None:
        points = [(math.log(r), math.log(n[r])) for r in range(1, RARE + 2) if n[r] > 0]
        slope = float(np.polyfit(*zip(*points), 1)[0]) if len(points) > 1 else -2.0
        slope = slope if slope < -1.01 else -2.0
        d = katz([0.0, *[r**slope for r in range(1, RARE + 2)]])
    return np.concatenate(([0.0], d))


def discounted(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.where(counts <= RARE, d[np.minimum(counts, RARE)], 1.0) * counts


def left_over(d: np.ndarray, rare: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mass for unseen words, denominator) of histories; ``rare[r - 1]`` counts their words seen r times."""
    left = sum((1 - d[r]) * r * rare[r - 1] for r in range(1, RARE + 1))
    none = left <= 0
    den = total + none
    return np.where(none, 1.0, left) / np.maximum(den, 1), den


class _Model:
    """What a slice or shard must know: totals, discounts so far, hot histories per level."""

    def __init__(self, n: int, v: int, bits: int, split: int, unigram: np.ndarray, rare: list[float]):
        self.n, self.v, self.split, self.hot_limit = n, v, split, max(1, -(-n // HOT))
        self.bits = {2: bits}
        self.d = {1: unigram}
        self.unknown, den = (float(x) for x in left_over(unigram, np.array(rare[1 : RARE + 1]), np.float64(n)))
        self.den = int(den)
        self.hot: dict[int, np.ndarray] = {}  # level -> rows (history, rare counts..., lower mass), by history


class _Slice:
    """One slice's tokens, replayed level by level from what shards have told so far."""

    def __init__(self, heads: pd.DataFrame, told: pd.DataFrame, model: _Model, sep: int):
        head = heads.iloc[0]
        self.doc_ids, self.slice, self.model = head["doc_ids"], int(head["slice"]), model
        self.tokens = unpack(head["tokens"], np.uint32)
        self.counted = unpack(head["counted"], np.uint8).astype(bool)
        words = told[told["level"] == 1].rename(columns={"a": "ids", "b": "counts"})
        ids, self.counts = shards.told_to(head["shard_of"], words)
        ids += 1
        ids[0], self.counts[0] = 1, sep  # the end token
        self.ids = ids.astype(_U)
        self.told = {(int(r["level"]), int(r["shard"])): r for _, r in told[told["level"] > 1].iterrows()}
        ends = np.flatnonzero(self.tokens == 0)
        self.starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
        self.lengths = np.diff(np.concatenate((self.starts, [len(self.tokens)])))

    def replay(self, ask: int = 0, upto: int = 1):
        """Token probabilities of level ``upto``, or the questions (as rows) of level ``ask``."""
        m, t = self.model, np.concatenate((np.zeros(1, np.uint32), self.tokens))
        end = t == 0
        id_, c = self.ids[t], self.counts[t]
        self.known = c[1:] > 0
        p = np.where(self.known, discounted(m.d[1], c[1:]) / m.den, m.unknown)
        den = np.full(len(t) - 1, m.den, np.int64)
        for level in range(2, max(ask, upto) + 1):
            of, has = id_[:-1], c[:-1]
            follows = has > 0 if level == 2 else (has > 0) & ~end[:-1]
            at = np.flatnonzero(follows)
            # The last number is 0 where the shorter n-gram was not seen either: only the history matters then.
            last = np.where(c[1:] > 0, id_[1:], _U(0))[at]
            keys, first, back = np.unique(of[at] << _U(m.bits[level]) | last, return_index=True, return_inverse=True)
            total, history = has[at][first], of[at][first]
            hot = total >= m.hot_limit
            dealt = mix(np.where(hot, keys, history)) >> _U(64 - m.split) if m.split else np.zeros(len(keys), _U)
            order = np.argsort(dealt, kind="stable")
            cuts = np.flatnonzero(np.diff(dealt[order], prepend=_U(2**64 - 1))) if len(order) else []
            groups = [(int(dealt[g[0]]), g) for g in np.split(order, cuts[1:])] if len(order) else []
            if level == ask:
                mine = np.repeat(self.counted, self.lengths)[at]
                n = np.bincount(back[mine], minlength=len(keys))
                lower_c, lower_den = c[1:][at][first], np.where(c[1:] > 0, den, 0)[at][first]
                return [("ask", self.slice, level, s, pack_counts(np.diff(keys[g], prepend=_U(0))), pack_counts(n[g]), pack_counts(lower_c[g]),
                         pack_counts(lower_den[g]), pack(hot[g].astype(np.uint8)), None) for s, g in groups]
            count, number = np.zeros(len(keys), np.int64), np.zeros(len(keys), _U)
            left, below = np.zeros((RARE, len(keys)), np.int64), np.zeros(len(keys))
            for s, g in groups:
                told = self.told[level, s]
                count[g] = unpack_counts(told["a"])
                if told["b"] is not None:
                    number[g] = unpack_counts(told["b"]).astype(_U)
                cold = g[~hot[g]]
                if len(cold):
                    _, which = np.unique(history[cold], return_inverse=True)
                    left[:, cold] = unpack_counts(told["c"]).reshape(RARE, -1)[:, which]
                    below[cold] = unpack(told["d"], np.float64)[which]
            if hot.any():
                rows = m.hot[level]
                which = np.searchsorted(rows[:, 0], history[hot].astype(np.float64))
                left[:, hot], below[hot] = rows[which, 1:-1].T.astype(np.int64), rows[which, -1]
            free, dens = left_over(m.d[level], left, total)
            alpha = free / (1 - below)
            seen = count > 0
            longer = discounted(m.d[level], count) / dens
            p[at] = np.where(seen[back], longer[back], alpha[back] * p[at])
            new_c, new_id = np.zeros(len(t), np.int64), np.zeros(len(t), _U)
            new_c[at + 1], new_id[at + 1] = count[back], number[back]
            den[at] = dens[back]
            id_, c = new_id, new_c
        return p

    def scores(self, order: int) -> pd.DataFrame:
        m = self.model
        p = np.log10(self.replay(upto=order))
        words = np.log10((self.counts[self.tokens] + 1) / (m.n + m.v + 1))
        add = lambda x: np.add.reduceat(x, self.starts)
        return pd.DataFrame({
            "doc_id": [None if x is None else int(x) for x in self.doc_ids], "counted": self.counted, "n_tokens": self.lengths,
            "n_known": add(self.known.astype(np.int64)), "train_tokens": m.n, "base_score": add(words), "score": add(p)}).astype({"doc_id": object})


def _asks(model: _Model, sep: int, level: int):
    """Slice and all that shards have told it -> its questions about n-grams of length ``level``."""
    return lambda heads, told: pd.DataFrame(_Slice(heads, told, model, sep).replay(ask=level), columns=_NAMES)


def _sum(model: _Model, level: int, numbered: bool):
    """All questions of a shard -> its part of the n-gram table, and what each slice must know."""
    bits, d, split = model.bits[level], model.d[level - 1], model.split

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        asked = [np.cumsum(unpack_counts(a).astype(_U), dtype=_U) for a in rows["a"]]
        join = lambda column, read: np.concatenate([read(x) for x in rows[column]])
        every = np.concatenate(asked)
        keys, first, back = np.unique(every, return_index=True, return_inverse=True)
        total = np.bincount(back, weights=join("b", unpack_counts), minlength=len(keys)).astype(np.int64)
        lower_c, lower_den = join("c", unpack_counts)[first], join("d", unpack_counts)[first]
        hot = join("e", lambda x: unpack(x, np.uint8))[first].astype(bool)
        seen = total > 0
        history = keys >> _U(bits)
        start = np.flatnonzero(np.concatenate(([True], history[1:] != history[:-1])))
        rare = np.stack([np.add.reduceat((total == r).astype(np.int64), start) for r in range(1, RARE + 1)])
        below = np.add.reduceat(np.where(seen, discounted(d, lower_c) / np.maximum(lower_den, 1), 0.0), start)
        heads, head_hot = history[start], hot[start]
        number = np.where(seen, ((np.cumsum(seen) - 1) << split) + shard + 1, 0)
        out = []
        for slice_, mine in zip(rows["slice"], asked):
            at = np.searchsorted(keys, mine)
            own = np.unique(history[at][~hot[at]])
            which = np.searchsorted(heads, own)
            out.append(("tell", slice_, level, shard, pack_counts(total[at]), pack_counts(number[at]) if numbered else None,
                        pack_counts(rare[:, which].ravel()), pack(below[which]), None, None))
        of_counts = [float(seen.sum()), *[float(np.count_nonzero(total == r)) for r in range(1, RARE + 2)]]
        out.append(("ngrams", None, level, shard, pack_counts(np.diff(keys[seen], prepend=_U(0))), pack_counts(total[seen]), None, None, None, of_counts))
        for i in np.flatnonzero(head_hot):
            out.append(("hot", None, level, shard, None, None, None, None, None, [float(heads[i]), *rare[:, i].astype(float), float(below[i])]))
        return pd.DataFrame(out, columns=_NAMES)
    return run


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Written in a folder per kind of row, and read back."""
    df.write.mode("overwrite").partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scores(texts: DataFrame, path: str, order: int = ORDER) -> DataFrame:
    """Scores of a table (doc_id, text, counted) by the model of its ``counted`` texts; the n-gram tables stay under ``path``."""
    docs = texts.select("doc_id", "text", F.lit("").alias("part"), "counted")
    slices = shards.cut(docs, tokens_of, f"{path}/slices")
    words = shards.word_totals(slices, f"{path}/words")
    places = [F.get("numbers", F.lit(i)) for i in range(3 + RARE + 1)]
    sums = words.where("numbers IS NOT NULL").agg(F.max(places[0]).alias("top"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(places[1:])]).first()
    size = slices.agg(F.sum("n_counted").alias("sep"), F.sum(F.col("n_words") + F.coalesce(F.size("doc_ids"), F.lit(0))).alias("tokens")).first()
    sep = int(size["sep"] or 0)  # the count of the end token
    of_counts = [0.0, *[float(sums[f"s{1 + r}"] or 0) + (sep == r) for r in range(1, RARE + 2)]]
    n, v = int(sums["s0"] or 0) + sep, int(sums["s1"] or 0) + (sep > 0)
    model = _Model(n, v, (int(sums["top"] or 0) + 1).bit_length(), shards.shard_bits(int(size["tokens"] or 0), SHARD_ENTRIES), discounts(of_counts), of_counts)
    heads = slices.where("shard < 0").select("slice", "doc_ids", "counted", "tokens", "shard_of")
    known = words.where("slice IS NOT NULL").select("slice", F.lit(1).alias("level"), "shard", F.col("ids").alias("a"), F.col("counts").alias("b"),
                                                    F.lit(None).cast("binary").alias("c"), F.lit(None).cast("binary").alias("d"))
    for level in range(2, order + 1):
        if model.bits[level] > 32:
            raise ValueError("more than 2**32 n-grams of one length")
        asks = heads.groupBy("slice").cogroup(known.groupBy("slice")).applyInPandas(_asks(model, sep, level), _STEP)
        told = _stored(asks.groupBy("shard").applyInPandas(_sum(model, level, level < order), _STEP), f"{path}/level-{level}")
        numbers = [F.get("numbers", F.lit(i)) for i in range(RARE + 2)]
        counts = told.where("kind = 'ngrams'").agg(F.max(numbers[0]).alias("most"), *[F.sum(x).alias(f"n{r}") for r, x in enumerate(numbers) if r]).first()
        model.d[level] = discounts([0.0, *[float(counts[f"n{r}"] or 0) for r in range(1, RARE + 2)]])
        # At most HOT histories, as each holds over 1 / HOT of the tokens.
        hot = told.where("kind = 'hot'").groupBy(numbers[0].alias("h")).agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(numbers) if i])
        model.hot[level] = np.array(sorted(map(tuple, hot.collect())), np.float64).reshape(-1, RARE + 2)
        model.bits[level + 1] = (int(counts["most"] or 0) << model.split).bit_length()
        known = known.unionByName(told.where("kind = 'tell'").select("slice", "level", "shard", "a", "b", "c", "d"))
    return heads.groupBy("slice").cogroup(known.groupBy("slice")).applyInPandas(lambda h, t: _Slice(h, t, model, sep).scores(order), SCORES)


def op12_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    held_out = fold(F.col("doc_id"), 7) == 2
    scored = scores(docs.withColumn("counted", ~held_out), work_folder(spark))
    return scored.select("doc_id", (~F.col("counted")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op12_katz": op12_katz}
SQL = {}
