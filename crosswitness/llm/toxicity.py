"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, accents off, look-alike letters and digit substitutions
mapped to one letter.  The lexicon is a fixed seed plus terms mined from the labels: words
whose families of documents (near copies count once) are toxic far more often than the rest.
A term's weight is its smoothed log odds.  A match inside an exception phrase does not count;
phrases are a fixed list plus mined neighbour pairs in which a term is mostly harmless.  The
sum over matches, also divided by the length, goes through a logistic curve fitted on a
bounded sample of labelled rows.

Defined results: null and empty texts score the curve's value for no matches; rows are scored
one by one, so repeated rows score alike; with no usable labels the fixed curve and seed apply;
an empty table gives an empty result; other columns are passed through or ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.llm.common import free_name, only, table, work_folder, write_table
from crosswitness.llm.labels import SAMPLE, fold, sample
from crosswitness.llm.textops import family, word_hashes

SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clownfish", "class clown", "pond scum", "sore loser")
SEED_WEIGHT = 4.0
THRESHOLD = 0.7
#: A term needs this many families of toxic documents, and this many times the odds of clean ones.
MIN_FAMILIES, MIN_ODDS, MAX_TERMS = 8, 6.0, 5000

#: Look-alike characters and the letter they stand for.  1, l, | and ! all become i.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ø": "o", "ł": "i", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i",
}
_SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i", "*": ""}
_INSIDE = re.compile(r"(?<=[^\W_])[@$!|*​‌‍­](?=[^\W_])")


class _Folding(dict):
    """Character table for str.translate: base letters of accented characters, then look-alikes; filled on demand."""

    def __missing__(self, code: int) -> str:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).lower()
        out = "".join(LOOK_ALIKES.get(c, c) for c in base)
        self[code] = out = "".join(c if c.isalnum() else " " for c in out)
        return out


_FOLDING = _Folding()
_ODD = set("@$!|*​‌‍­")


def folded(text: str | None) -> str:
    """Lower-case words of folded letters, divided by single spaces, with a space at either end."""
    text = text or ""
    if not _ODD.isdisjoint(text):
        text = _INSIDE.sub(lambda m: _SYMBOLS.get(m[0], ""), text)
    return f" {' '.join(text.translate(_FOLDING).split())} "


@dataclass
class Model:
    """Terms with weights, harmless phrases (all folded), and the curve over (1, sum, density)."""

    terms: dict[str, float]
    phrases: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (-4.0, 1.5, 2.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "phrases": self.phrases, "curve": self.curve, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for p in self.phrases:
                a.add_word(f" {p} ", (len(p) + 2, 0.0, p))
            for t, w in self.terms.items():
                a.add_word(f" {t} ", (len(t) + 2, w, t))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def sums(self, text: str | None) -> tuple[float, float]:
        """Weights of the matches, repeats counted by their logarithm: plain, and per hundred words."""
        t, a = folded(text), self.automaton()
        if not len(a):
            return 0.0, 0.0
        counts: dict[str, int] = {}
        found = [(end - n + 1, end, w, term) for end, (n, w, term) in a.iter(t)]
        spans = [(s, e) for s, e, _, term in found if term in self.phrases]
        for s, e, w, term in found:
            if w and not any(s >= x and e <= y for x, y in spans):
                counts[term] = counts.get(term, 0) + 1
        total = sum(self.terms[term] * (1 + math.log(n)) for term, n in counts.items())
        return total, 100 * total / max(20, t.count(" ") - 1)

    def features(self, texts) -> np.ndarray:
        s = np.array([self.sums(t) for t in texts], dtype=float).reshape(-1, 2)
        return np.column_stack([np.ones(len(s)), np.log1p(s[:, 0]), np.log1p(s[:, 1])])

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-self.features(texts) @ np.array(self.curve)))


def _labelled_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per labelled text: its distinct folded words and neighbour pairs of seed words, with its family."""
    seeds = {folded(t).strip() for t in SEED_TERMS}
    for b in batches:
        rows = []
        for text, y in zip(b["text"], b["y"]):
            w = folded(text).split()
            f = family(word_hashes((text or "").encode("utf-8", "surrogatepass"))[0])
            pairs = {f"{x} {z}" for x, z in zip(w, w[1:]) if x in seeds or z in seeds}
            rows += [(t, f, int(y)) for t in {*w, *pairs}]
        yield pd.DataFrame(rows, columns=["term", "family", "y"])


def _fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """Logistic regression by Newton steps with a small ridge."""
    c = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ c))
        grad = x.T @ (p - y) + 1e-2 * c
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(c)), grad)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in c)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable=None, bound: int = SAMPLE) -> Model:
    """Mine terms and exception phrases on Spark from at most ``bound`` labelled rows, and fit the curve on them."""
    seeds = {folded(t).strip(): SEED_WEIGHT for t in SEED_TERMS}
    phrases = frozenset(folded(p).strip() for p in EXCEPTIONS)
    root = work_folder(spark)
    chosen = write_table(sample(labels, "toxic", F.lit(True) if usable is None else usable, bound), f"{root}/sample")
    # At most ``bound`` rows of two numbers, so the broadcast is small whatever the table's size.
    texts = only(docs, doc_id="doc_id", text="text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")
    terms = texts.select("text", "y").mapInPandas(_labelled_terms, "term string, family long, y int")
    terms = terms.groupBy("term", "family").agg(F.max("y").alias("y"))  # near copies count once
    counts = terms.groupBy("term").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    counts = write_table(counts.where(F.col("toxic") + F.col("clean") >= MIN_FAMILIES), f"{root}/terms")
    n = chosen.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    bad, good = float(n[0] or 0), float(n[1] or 0)
    if not bad or not good:
        return Model(seeds, phrases)
    odds = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * (good / bad)
    mined = (counts.where((F.instr("term", " ") == 0) & (F.length("term") > 1) & (F.col("toxic") >= MIN_FAMILIES))
             .select("term", odds.alias("odds"), "toxic").where(F.col("odds") >= MIN_ODDS)
             .orderBy(F.desc("odds"), "term").limit(MAX_TERMS).collect())  # bounded
    harmless = (counts.where((F.instr("term", " ") > 0) & (F.col("clean") >= MIN_FAMILIES) & (odds < 0.5))
                .orderBy(F.desc("clean"), "term").limit(MAX_TERMS).collect())
    weights = {r["term"]: math.log(r["odds"]) for r in mined}
    found = {r["term"]: r for r in counts.where(F.col("term").isin(list(seeds))).collect()}
    for t in seeds:  # a seed word that the labels do not support weighs less
        if t in found:
            r = found[t]
            weights[t] = max(0.0, min(SEED_WEIGHT, math.log((r["toxic"] + 1) / (r["clean"] + 0.5) * (good / bad))))
    model = Model({**seeds, **weights}, phrases | frozenset(r["term"] for r in harmless))
    # Features of the sample: at most ``bound`` distinct ids, three numbers each.
    schema = "doc_id long, y int, a double, b double"

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = model.features(b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "a": x[:, 1], "b": x[:, 2]})

    got = texts.mapInPandas(measured, schema).groupBy("doc_id").agg(F.max("y").alias("y"), F.max("a").alias("a"), F.max("b").alias("b"))
    got = got.orderBy("doc_id").toPandas()
    x = np.column_stack([np.ones(len(got)), got["a"], got["b"]])
    model.curve = _fit_curve(x, got["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """The table with a score column; every whole text is scored where it lies, without a shuffle."""

    @F.pandas_udf("double")
    def scores(t: pd.Series) -> pd.Series:
        return pd.Series(model.scores(t))

    return docs.withColumn(into, scores(docs[f"`{text}`"].cast("string")))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable=None) -> DataFrame:
    """The documents that are not judged toxic, with all their columns."""
    name = free_name(docs, "toxicity")
    return score(docs, train(spark, docs, labels, usable), into=name).where(F.col(name) < THRESHOLD).drop(name)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(spark, docs, labels, fold(F.col("doc_id"), 3) != 1)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL = {}
