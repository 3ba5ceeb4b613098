"""Collocations of two to four words, counted exactly in counting quotient filters.

Texts are cut into pieces at punctuation and line ends, and into words at blanks.  A phrase can
only be frequent if its parts are, so counting goes by length: words; pairs of frequent words;
then three and four words whose pairs are all frequent.  Frequent words and pairs get numbers of
at most 32 bits, so every n-gram packs losslessly into one key of two numbers: (word, word),
(pair, word), (pair, pair).  Each slice of the texts counts its keys in quotient filters, one a
shard; a shard merges the sorted filters of all slices and answers the slices with the numbers of
its frequent pairs.  A frequent n-gram is thus one entry a slice, however often it occurs.

Scores are whole numbers from exact decimal division.  A phrase is dropped where a longer
candidate that holds it has at least ``ABSORB`` percent of its count.  The best of each part
(language) are found per salt first, so that no task sorts a whole part.

Defined results: null and empty texts have no words; a null part is ``und``; repeated rows count
each; ties in score and count go by the bytes of the phrase; an empty table gives an empty result;
ids and other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswitness.llm import shards
from crosswitness.llm.common import table, work_folder, write_table
from crosswitness.llm.shards import LOWER, QuotientFilter
from crosswitness.operators.skew import keyed_join, measure

LEAST, TOP, ABSORB, SCALE = 30, 2000, 80, 2_000_000
#: Entries a shard is meant to hold.
SHARD_ENTRIES = 2_000_000
SALTS = 64

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_FOLD = bytes(0xFF if i in _PIECE_ENDS else 0x20 if i == 9 else c for i, c in enumerate(LOWER))


def words_in_pieces(data: bytes) -> list[bytes]:
    """Words after A-Z are lower-cased, with an end token after each piece."""
    out = data.translate(_FOLD).replace(b"\xff", b" \xff ").split()
    out.append(shards.END)
    return out


def _words_and_ends(tokens: np.ndarray) -> np.ndarray:
    """The stream with one zero between stretches of numbered words."""
    before = np.concatenate((np.zeros(1, tokens.dtype), tokens[:-1]))
    return tokens[(tokens > 0) | (before > 0)]


def _filters(slice_: int, order: int, packed: np.ndarray, bits: int, shard_bits: int) -> list[tuple]:
    return [(slice_, order, s, f.to_bytes()) for s, f in QuotientFilter.of_shards(packed, bits, shard_bits)]


_STEP = "slice long, n int, shard int, data binary"
_COUNTED = "slice long, n int, packed long, f long, id long, data binary"


def _pairs(bits: int, shard_bits: int):
    """Slice and its word numbers -> the numbered stream (n = 0) and filters of its pairs (n = 2)."""
    def run(slices: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        head = slices.iloc[0]
        number, _ = shards.told_to(head["shard_of"], told)
        w = _words_and_ends(number.astype(np.uint64)[shards.unpack(head["tokens"], np.uint32)])
        packed = (w[:-1] << np.uint64(bits) | w[1:])[(w[:-1] > 0) & (w[1:] > 0)]
        out = [(head["slice"], 0, 0, shards.pack_counts(w)), *_filters(head["slice"], 2, packed, 2 * bits, shard_bits)]
        return pd.DataFrame(out, columns=["slice", "n", "shard", "data"])
    return run


def _longer(bits: int, pair_bits: int, shard_bits: int):
    """Numbered stream and its frequent pairs -> filters of three (pair, word) and four words (pair, pair)."""
    wide = max(bits, pair_bits)

    def run(streams: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for slice_, data in zip(streams["slice"], streams["data"]):
            w = shards.unpack_counts(data).astype(np.uint64)
            some = [(shards.unpack_counts(a), shards.unpack_counts(b)) for a, b in zip(answers["data"], answers["ids"])]
            known, id_ = (np.concatenate(c) for c in zip(*some)) if some else ((), ())
            if not len(known):  # an answer can name no pair at all
                continue
            order = np.argsort(known)
            known, id_ = known[order].astype(np.uint64), id_[order].astype(np.uint64)
            packed = w[:-1] << np.uint64(bits) | w[1:]
            at = np.minimum(np.searchsorted(known, packed), len(known) - 1)
            pair = np.where((known[at] == packed) & (w[:-1] > 0) & (w[1:] > 0), id_[at], np.uint64(0))
            three = (pair[:-1] > 0) & (pair[1:] > 0)
            out += _filters(slice_, 3, (pair[:-1] << np.uint64(wide) | w[2:])[three], 2 * wide, shard_bits)
            four = three[:-1] & (pair[2:] > 0)
            out += _filters(slice_, 4, (pair[:-2] << np.uint64(wide) | pair[2:])[four], 2 * wide, shard_bits)
        return pd.DataFrame(out, columns=["slice", "n", "shard", "data"])
    return run


def _merge(least: int, shard_bits: int, answer: bool):
    """All filters of a shard -> its frequent n-grams (slice null), and which of them each slice has."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, shard = key
        filters = [QuotientFilter.from_bytes(d) for d in rows["data"]]
        total = QuotientFilter.merged(filters)
        often = total.counts >= least
        total.keys, total.counts = total.keys[often], total.counts[often]
        packed = total.packed()
        ids = (np.arange(len(packed), dtype=np.int64) << shard_bits) + shard + 1
        table_ = pd.DataFrame({"slice": None, "n": n, "packed": packed.astype(np.int64), "f": total.counts, "id": ids, "data": None, "ids": None})
        if not answer or not len(packed):
            return table_
        told = []
        for slice_, f in zip(rows["slice"], filters):
            has = np.isin(total.keys, f.keys, assume_unique=True)
            told.append((slice_, n, None, None, None, shards.pack_counts(packed[has]), shards.pack_counts(ids[has])))
        return pd.concat([table_.astype(object), pd.DataFrame(told, columns=table_.columns).astype(object)])
    return run


def frequent_phrases(texts: DataFrame, path: str, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Of a table (part, text): the phrases of one to four words that occur at least ``least`` times, and the words per part.

    The phrases are (part, words array, f), written under ``path``.
    """
    spark = texts.sparkSession
    docs = texts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.coalesce("part", F.lit("und")).alias("part"), F.lit(True).alias("counted"))
    slices = shards.cut(docs, words_in_pieces, f"{path}/slices")
    sizes = slices.groupBy("part").agg(F.sum("n_words").alias("n"))
    totals = shards.word_totals(slices, f"{path}/words", least, listed=True)
    words = totals.where("word IS NOT NULL").select("part", "word", "f", "id")
    bits = max(1, shards.largest(words, "id").bit_length())
    n_words = int(slices.agg(F.sum("n_words")).first()[0] or 0)
    split = shards.shard_bits(n_words, SHARD_ENTRIES)
    if bits > 32:
        raise ValueError("more than 2**32 frequent words")
    split = min(split, 2 * bits)
    heads = slices.where("shard < 0").select("slice", "tokens", "shard_of").groupBy("slice")
    told = totals.where("slice IS NOT NULL").select("slice", "shard", "ids", "counts").groupBy("slice")
    step = heads.cogroup(told).applyInPandas(_pairs(bits, split), _STEP)
    step = write_table(step, f"{path}/pairs")
    merged = _COUNTED + ", ids binary"
    pairs = step.where("n = 2").groupBy("n", "shard").applyInPandas(_merge(least, split, True), merged)
    pairs = write_table(pairs, f"{path}/frequent-pairs")
    pair_table = pairs.where("slice IS NULL")
    pair_bits = max(1, shards.largest(pair_table, "id").bit_length())
    if pair_bits > 32:
        raise ValueError("more than 2**32 frequent pairs")
    wide = max(bits, pair_bits)
    split = min(split, 2 * wide)
    longer = (step.where("n = 0").groupBy("slice").cogroup(pairs.where("slice IS NOT NULL").groupBy("slice"))
              .applyInPandas(_longer(bits, pair_bits, split), _STEP))
    longer = longer.groupBy("n", "shard").applyInPandas(_merge(least, split, False), merged)
    longer = write_table(longer, f"{path}/frequent-longer")
    high = lambda c, b: F.shiftrightunsigned(F.col(c), b)
    low = lambda c, b: F.col(c).bitwiseAND(F.lit((1 << b) - 1))
    # Numbers back to words; each step looks a number up in a table of unique numbers.
    word = words.select(F.col("id"), "part", "word")
    second = words.select(F.col("id").alias("b"), F.col("word").alias("word_b"))
    two = pair_table.select("id", "f", high("packed", bits).alias("a"), low("packed", bits).alias("b"))
    two = _looked_up(two, word.withColumnRenamed("id", "a"), "a")
    two = _looked_up(two, second, "b").select("id", "part", F.array("word", "word_b").alias("words"), "f")
    two = write_table(two, f"{path}/two")
    rest = longer.select("n", "f", high("packed", wide).alias("a"), low("packed", wide).alias("b"))
    front = two.select(F.col("id").alias("a"), "part", "words")
    three = _looked_up(_looked_up(rest.where("n = 3"), front, "a"), second, "b").select("part", F.concat("words", F.array("word_b")).alias("words"), "f")
    back = two.select(F.col("id").alias("b"), F.col("words").alias("back"))
    four = _looked_up(_looked_up(rest.where("n = 4"), front, "a"), back, "b").select("part", F.concat("words", "back").alias("words"), "f")
    one = words.select("part", F.array("word").alias("words"), "f")
    every = one.unionByName(two.select("part", "words", "f")).unionByName(three).unionByName(four)
    return write_table(every, f"{path}/phrases"), sizes


def _looked_up(rows: DataFrame, facts: DataFrame, *on: str) -> DataFrame:
    """Join with a table of unique keys; keys of very many rows are measured and split."""
    load = measure({"rows": (rows, on)})["rows"]
    return keyed_join(rows, facts, list(on), "inner", load)


def collocations(texts: DataFrame, path: str, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of each part: part, rank, phrase, a, l, r, n, score."""
    phrases, sizes = frequent_phrases(texts, path, least)
    long = phrases.where(F.size("words") > 1)
    # Both sides of every cut, and their counts.  They are frequent themselves, as they occur at least as often.
    cuts = long.select("part", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    sides = cuts.select("part", "words", "a", "k", F.explode(F.array(
        F.struct(F.lit("l").alias("side"), F.slice("words", F.lit(1), F.col("k")).alias("half")),
        F.struct(F.lit("r").alias("side"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("half")))).alias("s"))
    sides = sides.select("part", "words", "a", "k", "s.side", F.col("s.half").alias("half"))
    sides = _looked_up(sides, phrases.select("part", F.col("words").alias("half"), F.col("f").alias("n_half")), "part", "half")
    both = sides.groupBy("part", "words", "a", "k").agg(*[F.max(F.when(F.col("side") == s, F.col("n_half"))).alias(s) for s in ("l", "r")])
    exact = F.expr(f"cast({SCALE}BD * cast(a AS decimal(20, 0)) AS decimal(38, 0)) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    scored = both.withColumn("score", exact).groupBy("part", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What longer candidates hold: a phrase of four words has five shorter ones.
    spots = F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: F.slice("words", i, m)))
    held = (phrases.where(F.size("words") > 2).select("part", "f", F.explode(F.array_distinct(F.flatten(spots))).alias("words"))
            .groupBy("part", "words").agg(F.max("f").alias("holder")))
    kept = scored.join(held, ["part", "words"], "left").where(F.col("holder").isNull() | (F.col("holder") * 100 < F.col("a") * ABSORB))
    named = kept.select("part", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    within = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", within("part", "salt")).where(F.col("rank") <= top)
    best = best.withColumn("rank", within("part").cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "part").select("part", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", F.col("lang").alias("part"))
    return collocations(docs, work_folder(spark)).withColumnRenamed("part", "lang")


OP13_SQL = r"""
WITH pieces AS MATERIALIZED (SELECT lang, row_number() OVER () AS piece, w FROM (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)) WHERE len(w) > 0),
toks AS MATERIALIZED (SELECT lang, piece, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM pieces),
g AS (SELECT lang, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM toks WINDOW p AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, phrase, n, count(*) AS a FROM (
  SELECT lang, w AS phrase, 1 AS n FROM g UNION ALL SELECT lang, w || ' ' || w2, 2 FROM g WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3, 3 FROM g WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, w || ' ' || w2 || ' ' || w3 || ' ' || w4, 4 FROM g WHERE w4 IS NOT NULL) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, n, a, unnest(generate_series(1, n - 1)) AS k FROM f WHERE n > 1),
scored AS (SELECT c.lang, c.phrase, c.n, c.a, c.k, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * c.a) // (x.a + y.a) AS BIGINT) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[c.k + 1:], ' ')),
cand AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, n, string_split(phrase, ' ') AS w, unnest(generate_series(2, n - 1)) AS m FROM f WHERE n > 2),
held AS (SELECT lang, phrase, max(a) AS holder FROM (
  SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(generate_series(1, n - m + 1)) AS i FROM parts)) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN held h USING (lang, phrase) WHERE holder IS NULL OR 100 * holder < 80 * c.a),
sizes AS (SELECT lang, count(*) AS n FROM toks GROUP BY 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, sizes.n AS n, score
FROM kept JOIN sizes USING (lang) QUALIFY rank <= 2000
"""
QUERIES = {"op13_collocations": op13_collocations}
SQL = {"op13_collocations": OP13_SQL}
