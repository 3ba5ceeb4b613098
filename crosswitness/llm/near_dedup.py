"""Near-duplicate detection with ProbMinHash signatures, banding and exact verification.

A text becomes a set of five-word shingles, all of weight 1, as the verification counts them.  Each
shingle sends exponential arrivals at the rate of its weight, each arrival to a random one of 125
places; a place keeps its earliest shingle, and a shingle stops once its next arrival is later than
all places (ProbMinHash).  Places agree with the Jaccard similarity of the sets, however often a
shingle is repeated.  25 bands of 5 places propose candidates: a pair at 0.8 is missed with probability 0.00005.

Texts with the same word sequence are one *class*; only classes are compared, so copies are
never expanded into pairs.  In a band bucket every member is compared exactly (Jaccard of the
shingle sets, whole texts) with the most central member.  Where that leaves members outside
the bucket's largest group, these are compared with all members, a block against a block at a
time, and only links that join two groups come out.  So no candidate pair that could join two
groups is left out, and what is written grows with the members, not with their pairs.  Groups
are the connected components.

Defined results: a text without words (null, empty) is like nothing and stays alone; a text of
one to four words has one shingle, itself; the representative is the smallest id (null ids last,
then an arbitrary but fixed order of rows); of rows that repeat id and text one stays; an empty
table gives an empty result; other columns are passed through or ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from crosswitness.llm.common import free_name, only, table, work_folder, write_table
from crosswitness.llm.components import components
from crosswitness.llm.textops import mix, shingles, word_hashes

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Members in a block when a bucket is searched in full.
BLOCK = 256
_U = np.uint64


def class_key(hashes: np.ndarray) -> bytes:
    """Names a word sequence."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, places: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (n_docs x places) of weighted shingles; ``doc`` tells whose a shingle is."""
    earliest = np.full(n_docs * places, np.inf)
    holder = np.zeros(n_docs * places, _U)
    active, time, turn = np.arange(len(shingle)), np.zeros(len(shingle)), 0
    while len(active):
        turn += 1
        r = mix(shingle[active] + _U((turn * 0x9E3779B97F4A7C15) % 2**64))
        time[active] -= np.log(((r >> _U(11)).astype(float) + 0.5) * 2.0**-53) / weight[active]
        place = doc[active] * places + (mix(r ^ _U(0xD1B54A32D192ED03)) % _U(places)).astype(np.int64)
        sooner = time[active] < earliest[place]
        a, p = active[sooner], place[sooner]
        np.minimum.at(earliest, p, time[a])
        won = time[a] == earliest[p]
        holder[p[won]] = shingle[a[won]]
        latest = earliest.reshape(n_docs, places).max(axis=1)
        active = active[time[active] < latest[doc[active]]]
    return holder.reshape(n_docs, places)


def bands(signatures: np.ndarray, n: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash per band; the band's number is part of it."""
    out = np.broadcast_to(np.arange(n, dtype=_U), (len(signatures), n)).copy()
    for i in range(rows):
        out = mix(out * _U(0x9E3779B97F4A7C15) + signatures[:, i::rows][:, :n])
    return out.view(np.int64)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ids, texts = b["doc_id"], [(t or "").encode("utf-8", "surrogatepass") for t in b["text"]]
        at = 0
        while at < len(texts):  # about 8 MB of text at a time
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= 8_000_000):
                size, to = size + len(texts[to]), to + 1
            keys, parts = [], []
            for t in texts[at:to]:
                h = word_hashes(t)[0]
                keys.append(class_key(h))
                parts.append(np.unique(shingles(h, WORDS)))
            n = np.array([len(p) for p in parts])
            doc = np.repeat(np.arange(len(parts)), n)
            sig = prob_minhash(doc, np.concatenate(parts), np.ones(len(doc)), len(parts))
            found = bands(sig)
            yield pd.DataFrame({"doc_id": ids.iloc[at:to].to_numpy(), "key": keys, "shingles": n, "bands": list(found)}).astype({"doc_id": ids.dtype})
            at = to


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose shingle sets reach the similarity; rows come sorted by leader, whose set is kept."""
    last, have = None, None
    for b in batches:
        good = []
        for a, x, y in zip(b["a"], b["text_a"], b["text_b"]):
            if a != last:
                last, have = a, np.unique(shingles(word_hashes(x.encode("utf-8", "surrogatepass"))[0], WORDS))
            other = np.unique(shingles(word_hashes(y.encode("utf-8", "surrogatepass"))[0], WORDS))
            shared = len(np.intersect1d(have, other, assume_unique=True))
            good.append(shared >= SIMILARITY * (len(have) + len(other) - shared))
        yield b.loc[good, ["a", "b"]]


def near_duplicates(spark: SparkSession, docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, class_id (smallest id of its near-duplicate group), kept, key (of its word sequence), n_rows (rows alike in id and key)."""
    root = work_folder(spark)
    rows = only(docs, doc_id=id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = write_table(rows.mapInPandas(_sign, "doc_id long, key binary, shingles long, bands array<long>"), f"{root}/signed")
    worded = signed.where("shingles > 0")
    classes = worded.groupBy("key").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    members = classes.select("key", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = write_table(members.join(sizes, "bucket"), f"{root}/members")
    central = write_table(members.groupBy("key").agg(F.sum("n").alias("centre")), f"{root}/central")
    members = write_table(members.join(central, "key").select("bucket", "key", "n", "centre"), f"{root}/ranked")

    # One text of each class that has a candidate.
    texts = _texts_of(docs, text, central.select("key"))
    texts = write_table(texts, f"{root}/texts")

    lead = write_table(members.groupBy("bucket").agg(F.max_by("key", F.struct("centre", "key")).alias("a")), f"{root}/leaders")
    edges = members.join(lead, "bucket").where("a <> key").select("a", F.col("key").alias("b")).distinct()
    links = write_table(_verified(write_table(edges, f"{root}/tried"), texts), f"{root}/links")
    labels = components(links, f"{root}/components")
    rest = _within_buckets(members, labels, texts, root)
    if not rest.isEmpty():
        links = write_table(links.union(_verified(rest, texts)), f"{root}/all-links")
        labels = components(links, f"{root}/all-components")
    return _labelled(signed, labels, root)


def _texts_of(docs: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": [class_key(word_hashes((t or "").encode("utf-8", "surrogatepass"))[0]) for t in b["text"]], "text": b["text"]})

    # The keys grow with the documents, so they are never broadcast, also where they happen to be few.
    return only(docs, text=text).mapInPandas(keyed, "key binary, text string").join(keys.hint("merge"), "key", "left_semi").dropDuplicates(["key"])


def _verified(edges: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return edges.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInPandas(_similar, "a binary, b binary")


def _within_buckets(members: DataFrame, labels: DataFrame, texts: DataFrame, root: str) -> DataFrame:
    """Further links inside the buckets that are not connected yet, at most one for each two groups and block pair.

    Members outside a bucket's largest group meet all members, a block of each at a time, so no
    task sees more than two blocks.  Sets travel as 32-bit shingle hashes; links are verified in full afterwards.
    """
    now = members.join(labels.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
    now = write_table(now, f"{root}/labelled-members")
    sizes = now.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("groups"))
    buckets = buckets.where("groups > 1").select(
        "bucket", F.col("top.label").alias("top"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("rest"))
    buckets = write_table(buckets, f"{root}/open")
    sets = write_table(texts.mapInPandas(_short_sets, "key binary, short binary"), f"{root}/sets")
    rows = now.join(buckets, "bucket").join(sets, "key")
    cols = ("bucket", "x", "y", "outside", "key", "label", "short")
    block = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = rows.withColumn("y", block("blocks")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("rest") - 1))).withColumn("outside", F.lit(False)).select(*cols)
    others = rows.where("label <> top").withColumn("x", block("rest")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = others.withColumn("outside", F.lit(True)).select(*cols)
    found = every.unionByName(others).groupBy("bucket", "x", "y").applyInPandas(_block_links, "a binary, b binary")
    return write_table(found.distinct(), f"{root}/block-links")


def _short_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        sets = [np.unique(shingles(word_hashes(t.encode("utf-8", "surrogatepass"))[0], WORDS).astype(np.uint32)).tobytes() for t in b["text"]]
        yield pd.DataFrame({"key": b["key"], "short": sets})


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the groups of one block pair; a sorted list of (shingle, member) gives all intersections of an outsider."""
    every, outside = rows[~rows["outside"]].sort_values("key"), rows[rows["outside"]].sort_values("key")
    sets = [np.frombuffer(s, np.uint32) for s in every["short"]]
    keys, group = every["key"].to_list(), every["label"].to_list()
    joined: dict[bytes, bytes] = {}

    def top(x: bytes) -> bytes:
        while x in joined:
            x = joined[x]
        return x

    found = []
    if len(sets) and len(outside):
        n = np.array([len(s) for s in sets])
        owner, flat = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for key, label, short in zip(outside["key"], outside["label"], outside["short"]):
            own = np.frombuffer(short, np.uint32)
            lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            count = hi - lo
            at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
            shared = np.bincount(owner[at], minlength=len(sets))
            for i in np.flatnonzero(shared >= (SIMILARITY - 1e-6) * (n + len(own) - shared)):
                x, y = top(label), top(group[i])
                if x != y:
                    joined[x] = y
                    found.append((key, keys[i]))
    return pd.DataFrame(found, columns=["a", "b"])


def _labelled(signed: DataFrame, labels: DataFrame, root: str) -> DataFrame:
    every = signed.select("doc_id", "key", "shingles").join(labels.withColumnRenamed("node", "key"), "key", "left")
    # A text without words is a group of its own row.
    every = every.withColumn("group", F.when(F.col("shingles") > 0, F.coalesce("label", "key")))
    every = every.withColumn("row", F.monotonically_increasing_id()).drop("label")
    every = write_table(every, f"{root}/grouped")
    first = every.where("shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first"))
    first = write_table(first.select("group", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("first_row")), f"{root}/first")
    out = every.join(first, "group", "left")
    return out.select("doc_id", F.when(F.col("shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                      ((F.col("shingles") == 0) | (F.col("row") == F.col("first_row"))).alias("kept"), "key", "shingles")


def kept_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns."""
    found = near_duplicates(spark, docs).where("kept AND shingles > 0").select("doc_id", "key")
    found = write_table(found, f"{work_folder(spark)}/kept")
    key, names = free_name(docs, "word_key"), docs.columns
    schema = StructType([*docs.schema.fields, StructField(key, BinaryType()), StructField(f"{key}_none", BooleanType())])

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hashes = [word_hashes((t or "").encode("utf-8", "surrogatepass"))[0] for t in b["text"]]
            yield b.assign(**{key: [class_key(h) for h in hashes], f"{key}_none": [not len(h) for h in hashes]})

    every = docs.mapInPandas(keyed, schema)
    alone = every.where(F.col(f"{key}_none")).select(*names)
    match = every["doc_id"].eqNullSafe(found["doc_id"]) & (every[key] == found["key"])
    rest = every.where(~F.col(f"{key}_none")).join(found, match, "left_semi")
    return alone.unionByName(rest.dropDuplicates(["doc_id", key]).select(*names))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


QUERIES = {"op4_minhash_near_dedup": op4_minhash_near_dedup}
SQL = {}
