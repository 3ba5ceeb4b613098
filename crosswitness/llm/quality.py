"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark computes the statistics of every whole text in one pass and writes them (about thirty
numbers a document).  Trees are grown on the statistics of a bounded sample of labelled rows:
values are binned by quantiles once, each node sums gradients per bin, the best cut wins.  The
forest is flattened into arrays (feature, threshold, child) and a batch of documents walks all
trees one level at a time in numpy.

Defined results: null and empty texts have all-zero statistics and are scored like any other;
rows are scored one by one, so repeated rows score alike; without both labels in the sample
the score is the share of label 1, or 0.5 with no labels; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.llm.common import only, table, work_folder, write_table
from crosswitness.llm.labels import SAMPLE, fold, sample
from crosswitness.llm.textops import LOWERED, shingles, word_hashes

THRESHOLD = 0.3
NAMES = (
    "bytes", "words", "lines", "word_len", "word_len_sd", "long_words", "short_words", "upper", "digits", "punct", "space", "non_ascii", "bars", "bangs",
    "hashes", "percents", "amps", "stars", "dollars", "dots", "commas", "capital_words", "distinct_words", "top_word", "same_as_last", "distinct_shingles",
    "line_len", "repeated_lines", "short_lines", "line_end_dot", "distinct_bytes", "entropy", "symbol_words",
)
_UPPER, _DIGIT, _SPACE = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_SPACE[[9, 10, 13, 32]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    share = lambda which: float(counts[which].sum()) / n
    one = lambda c: float(counts[ord(c)]) / n
    h, starts, ends = word_hashes(data)
    w = max(1, len(h))
    length = ends - starts
    p = counts[counts > 0] / n
    lines = data.split(b"\n")
    full = [x for x in lines if x.strip()]
    by_word = np.unique(h, return_counts=True)[1]
    runs = shingles(h, 3)
    after = raw[np.minimum(ends, n - 1)]
    return [
        np.log1p(n), np.log1p(len(h)), np.log1p(len(full)), float(length.mean()) if len(h) else 0.0, float(length.std()) if len(h) else 0.0,
        float((length > 12).sum()) / w, float((length < 3).sum()) / w, share(_UPPER), share(_DIGIT), share(_PUNCT), share(_SPACE),
        float(counts[128:].sum()) / n, one("|"), one("!"), one("#"), one("%"), one("&"), one("*"), one("$"), one("."), one(","),
        float((LOWERED[raw[starts]] != raw[starts]).sum()) / w, len(by_word) / w, float(by_word.max()) / w if len(h) else 0.0,
        float((h[1:] == h[:-1]).sum()) / w, len(np.unique(runs)) / max(1, len(runs)),
        np.log1p(n / max(1, len(full))), 1 - len(set(full)) / max(1, len(full)), sum(len(x) < 30 for x in full) / max(1, len(full)),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in full) / max(1, len(full)),
        float((counts > 0).sum()), float(-(p * np.log2(p)).sum()), float((_PUNCT[after] & (after != 46) & (after != 44)).sum()) / w,
    ]


@dataclass
class Forest:
    """Trees laid end to end: a node's feature (-1 at leaves), cut, left child (right is next), and value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; all trees of all rows descend together."""
        if not len(self.roots):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Forest:
    """Boost trees on the log loss; each level is chosen from per-bin sums of gradients and curvatures."""
    base = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    feature, cut, left, value, roots = [], [], [], [], []
    margin = np.full(len(y), base)

    def node() -> int:
        for column, v in ((feature, -1), (cut, 0.0), (left, 0), (value, 0.0)):
            column.append(v)
        return len(feature) - 1

    offsets = np.arange(x.shape[1]) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, c = y - p, p * (1 - p)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(len(y)))]
        for level in range(depth + 1):
            following = []
            for at, rows in open_nodes:
                total_g, total_c = g[rows].sum(), c[rows].sum()
                best = (1e-6, None)
                if level < depth and len(rows) >= 2 * least:
                    flat = (binned[rows] + offsets).ravel()
                    size = bins * x.shape[1]
                    sums = [np.bincount(flat, weights=np.repeat(v, x.shape[1]), minlength=size).reshape(-1, bins).cumsum(axis=1)
                            for v in (g[rows], c[rows], np.ones(len(rows)))]
                    gl, cl, nl = sums
                    gain = gl**2 / (cl + ridge) + (total_g - gl) ** 2 / (total_c - cl + ridge) - total_g**2 / (total_c + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > best[0] and b < len(cuts[j]):
                        best = (gain[j, b], (int(j), int(b)))
                if best[1] is None:
                    value[at] = rate * total_g / (total_c + ridge)
                    margin[rows] += value[at]
                    continue
                j, b = best[1]
                feature[at], cut[at] = j, float(cuts[j][b])
                lo = node()
                hi = node()
                left[at] = lo
                goes = binned[rows, j] <= b
                following += [(lo, rows[goes]), (hi, rows[~goes])]
            open_nodes = following
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots), base, depth)


def measured(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id and the statistics of each whole text, as an array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [np.asarray(statistics(t), np.float64) for t in b["text"]]})

    rows = only(docs, doc_id=id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, x array<double>")


def train(spark: SparkSession, stats: DataFrame, labels: DataFrame, label: str = "quality", usable=None, bound: int = SAMPLE) -> Forest:
    """Grow the forest on at most ``bound`` labelled rows; ``stats`` is the written result of ``measured``."""
    chosen = sample(labels, label, F.lit(True) if usable is None else usable, bound)
    # Bounded on both sides of the join: one row of statistics per chosen id.
    got = stats.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("x").alias("x")).orderBy("doc_id").toPandas()
    y = got["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        none = np.zeros(0)
        return Forest(none.astype(int), none, none.astype(int), none, none.astype(int), float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))), 0)
    return grow(np.vstack(got["x"].to_list()), y)


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """doc_id and score of every row of statistics."""

    @F.pandas_udf("double")
    def scores(x: pd.Series) -> pd.Series:
        m = np.vstack(x.to_list()) if len(x) else np.zeros((0, len(NAMES)))
        return pd.Series(np.concatenate([forest.scores(m[i : i + 2048]) for i in range(0, len(m), 2048)] or [np.zeros(0)]))

    return stats.select("doc_id", scores("x").alias("score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = write_table(measured(table(spark, sf_dir, "documents")), f"{work_folder(spark)}/statistics")
    forest = train(spark, stats, table(spark, sf_dir, "labels"), usable=fold(F.col("doc_id"), 5) != 0)
    return score(stats, forest).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
SQL = {}
