"""Line deduplication with a log-template tree.

A line is parsed to a leaf of a fixed-depth tree: its number of tokens, then its leading
tokens, with tokens that hold a digit read as the wildcard.  Inside a leaf, a token stays in the
template where enough documents have it at that place; other tokens are variable fields.  A
template must keep most of its tokens.  Templates that recur across documents are dropped with
all the lines that fit them.

Support is counted in *families* of documents, the verified near-duplicate groups of ``near_dedup``:
copies of one document count once, so a document is not emptied because it has copies, and
documents that share less than such copies do count each, also where the shared passage is most
of them.  A family counts once for a token and once for a template, however many lines it has there.
A template recurs when at least ``MIN_DOCS`` families have it, or ``SHORT_DOCS`` where the line is
under ``MIN_WORDS`` long.  A second template keeps every token that two families have at its place; where
``LONG_WORDS`` or more of it are constant, it recurs as soon as two unlike documents have it:
two whose shingle sets have a Jaccard similarity under ``UNLIKE``, so that heavily edited copies do not
empty each other.  Lengths are in blank-separated tokens, or in ten bytes each where that is more.

Work is on distinct masked lines after a map-side reduction, so a line that a third of all
documents hold is one row.  Only the final join brings texts and their dropped lines together.

Defined results: a null text has no lines and stays null; blank lines and lines without a word
are never dropped; a document whose lines all go stays with an empty text; repeated
rows get the same text; an empty table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from crosswitness.llm.common import free_name, only, table, work_folder, write_table
from crosswitness.llm.near_dedup import near_duplicates
from crosswitness.llm.textops import family, shingles, word_hashes  # noqa: F401  (the tests take them from here)

#: A line's leaf is its token count and so many leading tokens.
DEPTH = 3
MIN_WORDS, LONG_WORDS = 4, 20
MIN_DOCS, SHORT_DOCS, LONG_DOCS = 10, 100, 2
UNLIKE = 0.4
#: Share of a template's tokens that must be constant.
CONSTANT = 0.7
WILD = "<*>"


_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W_]")


def masked(line: str) -> list[str]:
    """Tokens of a line, those with a digit as the wildcard."""
    tokens = line.split()
    return [WILD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _name(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _lines(text: str | None) -> dict[str, int]:
    """Distinct masked lines of a text with their leaves."""
    out = {}
    for line in (text or "").split("\n"):
        t = masked(line)
        if _WORD.search(line):
            out[" ".join(t)] = int.from_bytes(_name(" ".join([str(len(t)), *t[:DEPTH]]))[:8], "little", signed=True)
    return out


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Leaf and name of each distinct line of each text, with the text's name."""
    for b in batches:
        rows = []
        for text in dict.fromkeys(b["text"]):
            if lines := _lines(text):
                own = _name(text)
                rows += [(leaf, _name(line), own, max(line.count(" ") + 1, len(line.encode("utf-8", "surrogatepass")) // 10)) for line, leaf in lines.items()]
        yield pd.DataFrame(rows, columns=["leaf", "name", "own", "words"]).astype({"leaf": "int64", "words": "int64"})


def _owned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct texts of a batch with their names."""
    for b in batches:
        yield pd.DataFrame([(_name(t), t) for t in dict.fromkeys(b["text"]) if t], columns=["own", "text"], dtype=object)


def _spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The named lines of each text in full."""
    for b in batches:
        rows = []
        for text, names in zip(b["text"], b["names"]):
            wanted = set(names)
            lines = dict.fromkeys(" ".join(masked(x)) for x in text.split("\n"))
            rows += [(name, line) for line in lines if (name := _name(line)) in wanted]
        yield pd.DataFrame(rows, columns=["name", "line"], dtype=object)


def _families(spark: SparkSession, texts: DataFrame, own: DataFrame, root: str) -> DataFrame:
    """own, kin: the near-duplicate group of each named text (own, names); the texts are written with their names."""
    # The names grow with the documents, so they are never broadcast.
    named = texts.mapInPandas(_owned, "own binary, text string").dropDuplicates(["own"]).join(own.hint("merge"), "own")
    number = F.conv(F.substring(F.hex("own"), 1, 15), 16, 10).cast("long")
    named = write_table(named.select("own", number.alias("id"), "text", "names"), f"{root}/candidates")
    kin = near_duplicates(spark, named.select("id", "text"), id="id").select(F.col("doc_id").alias("id"), F.col("class_id").alias("kin"))
    return write_table(named.select("own", "id").join(kin, "id").select("own", "kin").distinct(), f"{root}/families")


def recurring_lines(spark: SparkSession, docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, root: str | None = None) -> DataFrame:
    """Names of the masked lines whose template recurs, with the template and its families."""
    root = root or work_folder(spark)
    texts = only(docs, text=text)
    held = write_table(texts.mapInPandas(_parsed, "leaf long, name binary, own binary, words long").distinct(), f"{root}/parsed")
    lines = held.groupBy("leaf", "name").agg(F.count(F.lit(1)).alias("texts"), F.max("words").alias("words"))
    leaves = lines.groupBy("leaf").agg(F.sum("texts").alias("n"), F.max("words").alias("words")).where(F.col("n") >= _needed(F.col("words"), min_docs)).select("leaf")
    leaves = write_table(leaves, f"{root}/leaves")
    held = held.join(leaves, "leaf", "left_semi")
    # Each line is spelled out by one of its texts, the lowest, where that is read for its family.
    speaker = held.groupBy("name").agg(F.min("own").alias("own"))
    owners = held.select("own", F.lit(None).cast("binary").alias("name")).distinct().unionByName(speaker)
    kin = _families(spark, texts, owners.groupBy("own").agg(F.collect_list("name").alias("names")), root)
    held = write_table(held.join(kin, "own").groupBy("leaf", "name", "kin").agg(F.min("own").alias("own")), f"{root}/kin")
    # Families with one line in a leaf are summed up by line; the others are told apart at each token and template.
    several = held.groupBy("leaf", "kin").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("leaf", "kin", F.lit(True).alias("several"))
    held = write_table(held.join(several, ["leaf", "kin"], "left"), f"{root}/kin-lines")
    several = held.where("several").select("leaf", "name", "kin")
    single = held.groupBy("leaf", "name").agg(F.count_if(F.col("several").isNull()).alias("n"))
    spelled = spark.read.parquet(f"{root}/candidates").where(F.size("names") > 0).select("text", "names").mapInPandas(_spelled, "name binary, line string")
    busy = write_table(single.join(spelled, "name"), f"{root}/busy")

    tokens = busy.select("leaf", "name", "n", F.posexplode(F.split("line", " ")).alias("at", "token")).where(F.col("token") != WILD)
    fixed = _supported(tokens, several, ["leaf", "at", "token"]).where(F.col("n") >= LONG_DOCS)
    fixed = write_table(fixed.select("leaf", "at", "token", F.col("n").alias("support")), f"{root}/fixed")
    tokens = busy.select("leaf", "name", "n", F.posexplode(F.split("line", " ")).alias("at", "token"))
    shaped = tokens.join(fixed, ["leaf", "at", "token"], "left").groupBy("leaf", "name", "n").agg(
        F.array_sort(F.collect_list(F.struct("at", "token", F.coalesce("support", F.lit(0)).alias("support")))).alias("parts"))
    shaped = write_table(shaped, f"{root}/shaped")
    often = _templates(shaped, min_docs)
    recurs = _supported(often, several, ["leaf", "template"]).join(often.groupBy("leaf", "template").agg(F.max("words").alias("words")), ["leaf", "template"])
    recurs = write_table(recurs.where(F.col("n") >= _needed(F.least("words", F.lit(LONG_WORDS - 1)), min_docs)).select("leaf", "template", "n"), f"{root}/templates")
    often = write_table(often.select("leaf", "name", "template").join(recurs, ["leaf", "template"]).select("name", "template", F.col("n").alias("families")), f"{root}/often")
    # Long lines that are left: one text of each family meets one leading text.
    long = _templates(shaped, LONG_DOCS).where(F.col("words") >= LONG_WORDS).join(often.select("name"), "name", "left_anti").select("leaf", "name", "template")
    long = write_table(long, f"{root}/long")
    one = held.join(long, ["leaf", "name"]).groupBy("leaf", "template", "kin").agg(F.min("own").alias("own"))
    one = write_table(one, f"{root}/holders")
    lead = one.groupBy("leaf", "template").agg(F.min("own").alias("a"), F.count(F.lit(1)).alias("families")).where(F.col("families") >= LONG_DOCS)
    pairs = write_table(one.join(lead, ["leaf", "template"]).where("own <> a").select("leaf", "template", "families", "a", F.col("own").alias("b")), f"{root}/pairs")
    unlike = _unlike(pairs.select("a", "b").distinct(), spark.read.parquet(f"{root}/candidates").select("own", "text"))
    unlike = pairs.join(write_table(unlike, f"{root}/unlike"), ["a", "b"]).groupBy("leaf", "template").agg(F.max("families").alias("families"))
    long = long.join(unlike, ["leaf", "template"]).select("name", "template", "families")
    return write_table(often.unionByName(long), f"{root}/recurring")


def _needed(words: Column, min_docs: int) -> Column:
    """Families that a line of so many words needs."""
    return F.when(words >= LONG_WORDS, min(LONG_DOCS, min_docs)).when(words >= MIN_WORDS, min_docs).otherwise(max(SHORT_DOCS, min_docs))


def _templates(shaped: DataFrame, support: int) -> DataFrame:
    """leaf, name, n, template and words (the length of its constant part) of the lines that are constant enough at this support."""
    constant = F.filter("parts", lambda p: (p["support"] >= support) & (p["token"] != WILD))
    words = F.greatest(F.size(constant), F.floor(F.octet_length(F.array_join(F.transform(constant, lambda p: p["token"]), " ")) / 10).cast("int"))
    spelled = F.array_join(F.transform("parts", lambda p: F.when(p["support"] >= support, p["token"]).otherwise(WILD)), " ")
    return shaped.where(F.size(constant) >= CONSTANT * F.size("parts")).select("leaf", "name", "n", spelled.alias("template"), words.alias("words"))


def _unlike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of named texts whose shingle sets have a similarity under ``UNLIKE``."""
    def far(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = []
            for x, y in zip(b["text_a"], b["text_b"]):
                x, y = (np.unique(shingles(word_hashes(t.encode("utf-8", "surrogatepass"))[0])) for t in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(shared < UNLIKE * (len(x) + len(y) - shared))
            yield b.loc[good, ["a", "b"]]

    a = texts.select(F.col("own").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("own").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInPandas(far, "a binary, b binary")


def _supported(rows: DataFrame, several: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct families per key (which holds the leaf): rows are (leaf, name, n families with this line only) with the key's columns."""
    once = rows.groupBy(*keys).agg(F.sum("n").alias("n"))
    more = several.join(rows.drop("n"), ["leaf", "name"]).select(*keys, "kin").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return once.unionByName(more).groupBy(*keys).agg(F.sum("n").alias("n"))


def deduplicated(spark: SparkSession, docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """The table with the lines of recurring templates taken out of the text; with ``counts`` also n_lines and n_dropped."""
    root = work_folder(spark)
    recurring = recurring_lines(spark, docs, text, min_docs, root).select("name")
    # Names of texts and lines only: one row per distinct text and line.
    held = spark.read.parquet(f"{root}/parsed").join(recurring, "name")
    held = write_table(held.groupBy("own").agg(F.collect_set("name").alias("dropped")), f"{root}/held")
    own, gone, n_lines, n_dropped = (free_name(docs, c) for c in ("own_text", "dropped_lines", "n_lines", "n_dropped"))
    schema = StructType(docs.schema.fields)

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{own: [_name(t) if t else None for t in b[text]]})

    def without(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, total, lost = [], [], []
            for t, g in zip(b[text], b[gone]):
                lines = [] if t is None else t.split("\n")
                g = set() if g is None else set(g)
                stay = [x for x in lines if _name(" ".join(masked(x))) not in g] if g else lines
                texts.append(t if len(stay) == len(lines) else "\n".join(stay))
                total.append(len(lines))
                lost.append(len(lines) - len(stay))
            yield b.drop(columns=[own, gone]).assign(**{text: texts, n_lines: total, n_dropped: lost})

    rows = docs.mapInPandas(named, StructType([*schema, StructField(own, BinaryType())]))
    rows = rows.join(held.select(F.col("own").alias(own), F.col("dropped").alias(gone)), own, "left").select(*[F.col(f"`{c}`") for c in docs.columns], own, gone)
    out = rows.mapInPandas(without, StructType([*schema, StructField(n_lines, LongType()), StructField(n_dropped, LongType())]))
    return out if counts else out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(spark, docs, counts=True).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"), "text")


QUERIES = {"op10_line_dedup": op10_line_dedup}
SQL = {}
