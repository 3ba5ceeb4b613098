"""Benchmark decontamination by winnowing.

Every window of 13 consecutive item words that occurs in a document is found.  Grams of 5 words
are hashed and the smallest hash of each run of 9 grams (13 words) is a fingerprint, so each
shared run of 13 words shares a fingerprint at the same place.  Document fingerprints meet
the benchmark's by hash; each hit is extended to the up to nine 13-word windows around it, and
windows are compared word by word.  Items of fewer than 13 words are one window each; their
grams are all kept instead of winnowed, one pass per length that occurs (12 at most).

Only hits, with the 21 words around each, leave the scan of the documents.  Results belong to
texts, not to rows: copies are judged once.  Spark broadcasts the benchmark's fingerprints when
their written size is under its threshold and sorts and merges otherwise.

Defined results: null or wordless texts have no words and no hits; wordless items are ignored;
an item without id marks words but is not listed; repeated item ids are listed once; repeated
documents give repeated rows; no other column is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswitness.llm.common import ascii_lower, let, only, table, words, work_folder, write_table

WINDOW, GRAM = 13, 5
RUN = WINDOW - GRAM + 1


def _grams(hashes: Column, n: int) -> Column:
    """Hash of the n words from each place on; places near the end see fewer words and must not be used."""
    return let(hashes, lambda a: F.transform(a, lambda x, i: F.xxhash64(x, *[F.get(a, i + k) for k in range(1, n)])))


def _hashed(df: DataFrame, *keep: str) -> DataFrame:
    """Words and word hashes of the column ``low``."""
    df = df.select(*keep, words(F.col("low")).alias("w"))
    return df.select(*keep, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"), F.size("w").alias("n"))


def _winnowed(df: DataFrame, *keep: str) -> DataFrame:
    """A row per fingerprint: its hash ``f`` and place ``p``; a text of under 13 words gives one row with null ``f``.

    The low 4 bits of a hash make room for the gram's number in its run, so the least value of a run names the place too.
    """
    df = df.select(*keep, "w", "n", F.transform(_grams(F.col("wh"), GRAM), lambda g: g.bitwiseAND(~15)).alias("g"))
    runs = F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0)))
    least = let(F.col("g"), lambda g: F.transform(runs, lambda j: j + F.least(*[F.get(g, j + k).bitwiseOR(k) for k in range(RUN)]).bitwiseAND(15).cast("int")))
    df = df.select(*keep, "w", "n", "g", F.when(F.col("n") >= WINDOW, F.array_distinct(least)).otherwise(F.array(F.lit(0))).alias("places"))
    # The outer form: a plain explode makes Spark filter on the whole expression a second time, at the scan.
    df = df.select(*keep, "w", "n", "g", F.posexplode_outer("places").alias("j", "p"))
    return df.select(*keep, "w", "n", "j", "p", F.when(F.col("n") >= WINDOW, F.get("g", F.col("p"))).alias("f"))


def _windows(benchmark: DataFrame) -> DataFrame:
    """The benchmark's windows: item_id, window (words joined by a space), length."""
    w = benchmark.select("item_id", words(ascii_lower(F.col("text"))).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", "w", F.least(F.size("w"), F.lit(WINDOW)).alias("length"))
    w = w.select("item_id", "w", "length", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("s"))
    return w.select("item_id", F.array_join(F.slice("w", F.col("s"), F.col("length")), " ").alias("window"), "length").distinct()


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document: doc_id, digest (of the lower-cased text), n_words, n_hit, spans (start, length), items."""
    root = work_folder(spark)
    d = only(docs, doc_id=id, text=text).select("doc_id", ascii_lower(F.col("text")).alias("low"))
    b = only(benchmark, item_id="item_id", text="text")
    windows = write_table(_windows(b), f"{root}/windows")
    lengths = sorted(r[0] for r in windows.where(F.col("length") < WINDOW).select("length").distinct().collect())  # 12 at most

    marks = _winnowed(_hashed(b.select(ascii_lower(F.col("text")).alias("low")))).where("f IS NOT NULL").select("f").distinct()
    marks = write_table(marks, f"{root}/fingerprints")
    hashed = _hashed(d.select("doc_id", F.unhex(F.sha2("low", 256)).alias("digest"), "low"), "doc_id", "digest")
    # The first row of each document is kept in any case: it carries the number of words.
    before = F.greatest(F.col("p") - (RUN - 1), F.lit(0))
    found = (_winnowed(hashed, "doc_id", "digest").join(marks.withColumn("hit", F.lit(True)), "f", "left")
             .where("j = 0 OR hit").select("doc_id", "digest", "n", "j", F.coalesce("hit", F.lit(False)).alias("hit"), before.alias("c"),
                                           F.slice("w", before + 1, WINDOW + RUN - 1).alias("around")))
    found = write_table(found, f"{root}/hits")

    hits = found.where("hit").dropDuplicates(["digest", "c", "around"])
    starts = F.explode(F.sequence(F.lit(0), F.least(F.lit(RUN - 1), F.size("around") - WINDOW)))
    tried = hits.where(F.size("around") >= WINDOW).select("digest", "c", "around", starts.alias("s")).select(
        "digest", (F.col("c") + F.col("s")).alias("start"), F.lit(WINDOW).alias("length"),
        F.array_join(F.slice("around", F.col("s") + 1, WINDOW), " ").alias("window")).distinct()
    parts = [tried]
    if lengths:
        for n in lengths:
            short = windows.where(F.col("length") == n).select(F.split("window", " ").alias("w")).select(
                F.get(_grams(F.transform("w", lambda x: F.xxhash64(x)), n), 0).alias("f")).distinct()
            short = write_table(short, f"{root}/short-{n}")
            at = hashed.select("digest", "w", "n", F.posexplode_outer(_grams(F.col("wh"), n)).alias("j", "f")).where(F.col("j") <= F.col("n") - n)
            at = at.join(short, "f", "left_semi")
            parts.append(at.select("digest", F.col("j").alias("start"), F.lit(n).alias("length"),
                                   F.array_join(F.slice("w", F.col("j") + 1, n), " ").alias("window")).distinct())
    tried = write_table(reduce(DataFrame.unionByName, parts), f"{root}/tried")
    matched = tried.join(windows, ["window", "length"])
    spans = F.array_sort(F.collect_set(F.struct("start", "length")))
    judged = matched.groupBy("digest").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    judged = write_table(judged.withColumn("n_hit", _covered(F.col("spans"))), f"{root}/judged")
    every = found.where("j = 0").select("doc_id", "digest", F.col("n").cast("bigint").alias("n_words"))
    return every.join(judged, "digest", "left").select(
        "doc_id", "digest", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,length:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _covered(spans: Column) -> Column:
    """Words inside the spans, which are sorted by start."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))

    def step(a, s):
        end = (s["start"] + s["length"]).cast("bigint")
        return F.struct((a["n"] + F.greatest(F.lit(0).cast("bigint"), end - F.greatest(a["end"], s["start"].cast("bigint")))).alias("n"),
                        F.greatest(a["end"], end).alias("end"))

    return F.aggregate(spans, zero, step, lambda a: a["n"])


def judged(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The query's columns; a document is contaminated when at least a twentieth of its words is hit."""
    c = contamination(spark, docs, benchmark)
    return c.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean_rows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    c = contamination(spark, docs, benchmark)
    bad = c.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select("digest").distinct()
    bad = write_table(bad, f"{work_folder(spark)}/contaminated")
    return docs.join(bad, F.unhex(F.sha2(ascii_lower(docs["text"]), 256)) == bad["digest"], "left_anti")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH word_lists AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
item_windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 13) AS length, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM word_lists WHERE kind = 'b' AND len(w) > 0)),
doc_windows AS (
  SELECT id AS doc_id, length, s, array_to_string(w[s : s + length - 1], ' ') AS win
  FROM (SELECT id, w, length, unnest(range(1, len(w) - length + 2)) AS s
        FROM word_lists, (SELECT DISTINCT length FROM item_windows) WHERE kind = 'd' AND len(w) >= length)),
hits AS (SELECT doc_id, s, length, item_id FROM doc_windows JOIN item_windows USING (win, length)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + length)) AS p FROM (SELECT DISTINCT doc_id, s, length FROM hits))
            GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM word_lists LEFT JOIN covered ON covered.doc_id = id LEFT JOIN items ON items.doc_id = id WHERE kind = 'd'
"""
QUERIES = {"op2_decontaminate": op2_decontaminate}
SQL = {"op2_decontaminate": OP2_SQL}
