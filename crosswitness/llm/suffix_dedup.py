"""Removal of byte strings of 50 that an earlier document already holds.

Suffixes are compared on their first 50 bytes.  As in difference-cover sorting, a sample of
positions (the cover) is named first, such that two equal strings always hold a sampled
position at the same offset; suffixes are then decided bucket by bucket, a bucket being the
suffixes that lead to one sampled position, and those whose position has one and the same name are
never looked at byte by byte.  The cover is content-defined: the smallest hash of a 26-byte gram in
each 25 successive grams (about 8 % of all positions).  An arithmetic difference cover with
the same guarantee would sample 19 % and would leave the suffixes themselves, 50 bytes each,
to be sorted; see the README.

1. Each document sends its cover positions: gram hash, name of the stretch of bytes that their
   strings span, id.  One shuffle by gram hash gives the smallest id of each name.  A later
   document with the name loses all strings of that stretch.
2. Where one gram stands in stretches of different names, the first document of each name sends
   its strings of 50 bytes, sorted and named, and the smallest id of each string decides.
3. Each document is read once more and its removed strings are merged into runs.

Only hashes, ids and the two joins with the texts travel; no group is collected but the answers
for one document, and a document is worked on a megabyte at a time.

Defined results: null counts as empty; a text of under 50 bytes loses nothing; a null id is
larger than every id; rows with the same id do not remove from one another, so repeated rows get the
same result; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswitness.llm.common import only, table, work_folder, write_table
from crosswitness.llm.textops import _tabled, mix

LENGTH, GRAM = 50, 26
RUN = LENGTH - GRAM + 1
_U = np.uint64
#: Bits that hold a place inside a slice; a slice with its overlap has fewer places.
_PLACE = _U((1 << 20) - 1)
SLICE = (1 << 20) - LENGTH


class Cover:
    """Cover positions of one slice of a text: ``lo`` and ``hi`` are the first and last string start that lead to each."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8).astype(_U) + _U(1)
        n = len(raw)
        self.up, self.down = _tabled(n + 1)
        self.total = np.concatenate((np.zeros(1, _U), np.cumsum(raw * self.up[:n], dtype=_U)))
        grams = n - GRAM + 1
        gram = mix((self.total[GRAM:] - self.total[: grams]) * self.down[:grams])
        # Leftmost smallest gram of each 25, by windows of doubling width; the low bits hold the place.
        least, width = (gram & ~_PLACE) | np.arange(grams, dtype=_U), 1
        while width < RUN:
            step = min(width, RUN - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        turn = np.flatnonzero(least[1:] != least[:-1]) + 1
        self.lo = np.concatenate(([0], turn))
        self.hi = np.concatenate((turn, [len(least)])) - 1
        at = (least[self.lo] & _PLACE).astype(np.int64)
        self.gram = gram[at]
        before, span = (at - self.lo).astype(_U), (self.hi - self.lo).astype(_U)
        whole = (self.total[self.hi + LENGTH] - self.total[self.lo]) * self.down[self.lo]
        self.stretch = mix(mix(whole) + before * _U(64) + span + _U(1))

    def names(self, starts: np.ndarray, n: int) -> np.ndarray:
        return mix((self.total[starts + n] - self.total[starts]) * self.down[starts])

    def starts(self, which: np.ndarray) -> np.ndarray:
        """All string starts of the chosen cover positions."""
        n = self.hi[which] - self.lo[which] + 1
        return np.repeat(self.lo[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def covers(data: bytes) -> Iterator[tuple[int, Cover]]:
    """(offset, cover) of the slices of a text; slices share 49 bytes, so each string start is in exactly one."""
    for at in range(0, len(data) - LENGTH + 1, SLICE):
        yield at, Cover(data[at : at + SLICE + LENGTH - 1])


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _flushed(names: tuple[str, ...], pieces: Iterator[tuple[int, tuple[np.ndarray, ...]]]) -> Iterator[pd.DataFrame]:
    """Tables of about 200,000 rows from (id, columns) pieces."""
    held, size = [], 0

    def out() -> pd.DataFrame:
        table = {name: np.concatenate([columns[i] for _, columns in held]).view(np.int64) for i, name in enumerate(names)}
        return pd.DataFrame(table | {"d": np.repeat(np.array([d for d, _ in held], np.int64), [len(columns[0]) for _, columns in held])})

    for piece in pieces:
        held.append(piece)
        size += len(piece[1][0])
        if size > 200_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def pieces():
        for b in batches:
            for d, text in zip(b["d"], b["text"]):
                for _, c in covers(_bytes(text)):
                    s, first = np.unique(c.stretch, return_index=True)
                    yield d, (c.gram[first], s)

    return _flushed(("gram", "stretch"), pieces())


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names of the strings in the stretches that a document is asked for, each once and sorted."""
    def pieces():
        for b in batches:
            for d, text, asked in zip(b["d"], b["text"], b["asked"]):
                wanted = np.asarray(asked, np.int64).view(_U)
                for _, c in covers(_bytes(text)):
                    if len(which := np.flatnonzero(np.isin(c.stretch, wanted))):
                        yield d, (np.unique(c.names(c.starts(which), LENGTH)),)

    return _flushed(("string",), pieces())


def removed_runs(data: bytes, gone: np.ndarray, late: np.ndarray) -> np.ndarray:
    """(start, end) rows of the removed runs of a text, given its lost stretches and strings."""
    runs = []
    for at, c in covers(data) if len(gone) or len(late) else ():
        lost = np.zeros(int(c.hi[-1]) + 1, bool)
        lost[c.starts(np.flatnonzero(np.isin(c.stretch, gone)))] = True
        if len(late):
            lost |= np.isin(c.names(np.arange(len(lost)), LENGTH), late)
        runs.append(np.flatnonzero(lost) + at)
    s = np.concatenate(runs) if runs else np.zeros(0, np.int64)
    if not len(s):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.diff(s) > LENGTH) + 1  # touching strings form one run
    return np.column_stack([s[np.concatenate(([0], new))], s[np.concatenate((new - 1, [len(s) - 1]))] + LENGTH])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    none = np.zeros(0, np.int64)
    for b in batches:
        rows = []
        for doc_id, text, gone, late in zip(b["doc_id"], b["text"], b["gone"], b["late"]):
            data = _bytes(text)
            runs = removed_runs(data, *(np.asarray(none if x is None else x, np.int64).view(_U) for x in (gone, late)))
            edges = [0, *runs.ravel().tolist(), len(data)]
            kept = b"".join(data[x:y] for x, y in zip(edges[0::2], edges[1::2]))
            rows.append((doc_id, len(data), int((runs[:, 1] - runs[:, 0]).sum()), runs.ravel().tolist(), kept))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "runs", "kept"])
        yield out.astype({"doc_id": b["doc_id"].dtype})


def deduplicated(spark: SparkSession, docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, runs (start, end, start, end, ... of removed bytes), kept (remaining bytes)."""
    root = work_folder(spark)
    rows = only(docs, doc_id=id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit(2**63 - 1)))
    cover = rows.select("d", "text").mapInPandas(_sampled, "gram long, stretch long, d long")
    # One shuffle: rows lie by gram, then stretch, then id, which serves both windows.
    cover = cover.repartition("gram").sortWithinPartitions("gram", "stretch", "d")
    gram, stretch = Window.partitionBy("gram"), Window.partitionBy("gram", "stretch")
    cover = cover.withColumn("mixed", (F.min("stretch").over(gram) < F.max("stretch").over(gram)) & (F.min("d").over(gram) < F.max("d").over(gram)))
    cover = cover.withColumn("first", F.min("d").over(stretch))
    marks = cover.where("d > first OR mixed").select("d", F.when(F.col("d") > F.col("first"), F.col("stretch")).alias("gone"), F.when(F.col("d") == F.col("first"), F.col("stretch")).alias("asked"))
    answers = write_table(marks.groupBy("d").agg(F.collect_list("gone").alias("gone"), F.collect_set("asked").alias("asked")), f"{root}/answers")
    strings = rows.select("d", "text").join(answers.where(F.size("asked") > 0).select("d", "asked"), "d").mapInPandas(_strings, "string long, d long")
    strings = write_table(strings, f"{root}/strings")
    firsts = strings.groupBy("string").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("string", "first")
    firsts = write_table(firsts, f"{root}/firsts")
    late = strings.join(firsts, "string").where("d > first").groupBy("d").agg(F.collect_set("string").alias("late"))
    lost = answers.select("d", "gone").join(late, "d", "left").where("size(gone) > 0 OR late IS NOT NULL")
    lost = write_table(lost, f"{root}/lost")
    out = rows.join(lost, "d", "left").select("doc_id", "text", "gone", "late")
    return out.mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, runs array<long>, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("runs") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
SQL = {}
