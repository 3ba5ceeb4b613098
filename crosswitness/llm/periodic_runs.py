"""Runs of words that repeat with a fixed period, found by recursive frequency splitting.

A run is a longest stretch of consecutive words with smallest period q that holds at least
``times`` periods and ``min_length`` words.  Each of its words occurs at least ``times`` times
inside it, so a word that is rarer within the current segment cannot be part of a run and
splits the segment.  Splitting is repeated on what is left until no segment changes.  The
surviving segments are scanned lag by lag: for lag q the aligned blocks of q words are compared
with their neighbours by hash, and only equal ones are compared word by word and extended, so a
segment of m words takes about m ln m steps instead of m * m.

Documents are worked on where they lie, without a shuffle; memory is bounded by one text.

Defined results: null and blank texts have no words, hence no run and an empty collapsed text; a
run never crosses documents; repeated rows are reported each; an empty table gives an empty
result; other columns are passed through, under clashing names too.  A null id is ordinary here,
and in the query it is never one of the altered texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from crosswitness.llm.common import free_name, let, only, table
from crosswitness.llm.textops import mix

MIN_LENGTH, TIMES = 24, 3
BLANKS = r"[\x20\x09-\x0D]+"
ROWS = 200

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 2**64)

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


def _edges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true."""
    at = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return at[0::2], at[1::2]


def split(ids: np.ndarray, min_length: int, times: int) -> list[tuple[int, int]]:
    """Segments in which every word occurs at least ``times`` times; everything else is in no run."""
    stable: list[tuple[int, int]] = []
    starts, ends = np.array([0]), np.array([len(ids)])
    while len(starts):
        long = ends - starts >= min_length
        starts, ends = starts[long], ends[long]
        n = ends - starts
        if not len(n):
            break
        of = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
        if len(n) == 1:
            here = ids[at]
            often = np.bincount(here)[here] >= times
        else:
            _, key, count = np.unique(of * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
            often = count[key] >= times
        changed = np.bincount(of, weights=~often, minlength=len(n)) > 0
        stable += zip(starts[~changed].tolist(), ends[~changed].tolist())
        # A place between two segments keeps their stretches apart.
        place = at[often & changed[of]]
        gap = np.flatnonzero(np.diff(place) != 1) + 1 if len(place) else np.zeros(0, np.int64)
        if len(place):
            starts = place[np.concatenate(([0], gap))]
            ends = place[np.concatenate((gap - 1, [len(place) - 1]))] + 1
        else:
            starts = ends = np.zeros(0, np.int64)
    return stable


def _first_mismatch(x: np.ndarray, i: int, q: int) -> int:
    """Smallest j >= i with x[j] != x[j + q], or where the text ends."""
    step, last = 64, len(x) - q
    while i < last:
        to = min(last, i + step)
        bad = np.flatnonzero(x[i:to] != x[i + q : to + q])
        if len(bad):
            return i + int(bad[0])
        i, step = to, step * 2
    return last


def _after_mismatch(x: np.ndarray, i: int, q: int) -> int:
    """Smallest j such that x[j:i] equals x[j + q : i + q]."""
    step = 64
    while i > 0:
        to = max(0, i - step)
        bad = np.flatnonzero(x[to:i] != x[to + q : i + q])
        if len(bad):
            return to + int(bad[-1]) + 1
        i, step = to, step * 2
    return 0


def lag_scan(x: np.ndarray, min_length: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    m = len(x)
    up, down = _powers(_BASE, m), _powers(_UNBASE, m)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(x.astype(_U) + _U(1)) * up, dtype=_U)))
    found: dict[tuple[int, int], int] = {}
    period_at, end_at = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for q in range(1, m // times + 1):
        least = max(min_length, times * q)
        block = np.diff(total[: m // q * q + 1 : q]) * down[: m // q * q : q]
        same = block[1:] == block[:-1]
        if not same.any():
            continue
        first, last = _edges(same)
        # A run holds all but two of the aligned blocks that would fit it at best.
        enough = last - first >= (least + 1) // q - 2
        for a, b in zip((first[enough] * q).tolist(), (last[enough] * q).tolist()):
            while a < b:
                p = int(period_at[a])
                if p and q % p == 0 and end_at[a] >= a + 2 * q:
                    break  # a multiple of the period of a run that is known
                to = _first_mismatch(x, a, q)
                start = _after_mismatch(x, a, q)
                end = to + q
                if end - start >= least and (start, end) not in found:
                    found[start, end] = q
                    period_at[start:end], end_at[start:end] = q, end
                a = (to // q + 1) * q
    return [(s, e - s, q) for (s, e), q in found.items()]


def runs_of(words: list[bytes], min_length: int = MIN_LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if len(words) < min_length:
        return []
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return sorted((
        (lo + s, n, q) for lo, hi in split(ids, min_length, times) for s, n, q in lag_scan(ids[lo:hi], min_length, times)
    ), key=lambda r: (r[0], r[2]))


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words without the repetitions: of each run the first period stays, unless another run drops it."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
    return b" ".join(kept).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed",
                  min_length: int = MIN_LENGTH, times: int = TIMES) -> DataFrame:
    """The table with the runs of each text (start and length in words) and the text without repetitions."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.iloc[i : i + ROWS]
                # bytes.split() without arguments splits at exactly the blanks \x20 and \x09 to \x0D
                words = [(t or "").encode("utf-8", "surrogatepass").split() for t in part[text]]
                got = [runs_of(w, min_length, times) for w in words]
                yield part.assign(**{
                    runs: [[dict(zip(RUN.names, r)) for r in g] for g in got],
                    collapsed: [_collapsed(w, g) for w, g in zip(words, got)]})

    return docs.mapInPandas(find, StructType([*docs.schema.fields, StructField(runs, ArrayType(RUN)), StructField(collapsed, StringType())]))


def without_repetitions(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with periodic repetitions taken out of their texts."""
    runs, short = free_name(docs, "runs"), free_name(docs, "collapsed")
    has = F.size(runs) > 0
    return periodic_runs(docs, text, runs, short).withColumn(text, F.when(has, F.col(short)).otherwise(F.col(text))).select(*docs.columns)


def altered(text: Column, doc_id: Column) -> Column:
    """The query's texts: in every tenth document, by crc32 of its id, the words from some place on repeat."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(
            w, lambda x, i: F.get(w, F.when(i < s["a"], i).otherwise((s["a"] + (i - s["a"]) % s["p"])).cast("int"))), " "))

    words = F.array_remove(F.split(text, BLANKS), "")
    return F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = periodic_runs(docs.withColumn("text", altered(F.col("text"), F.col("doc_id"))).select("doc_id", "text"))
    # The greatest exact exponent: length / period is compared as a product, so nothing is rounded.
    better = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(better(x, y), y).otherwise(x))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
SQL = {}
