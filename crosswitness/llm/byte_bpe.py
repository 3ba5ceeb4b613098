"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside Spark partitions.

Texts are cut into words by the vocabulary's pattern.  The distinct words of a slice of a
partition become rows (word, place, token), one per byte.  A recursive query joins neighbouring
tokens with the merge table, contracts each word's leftmost pair of least rank (rank and place in
one number, so the least one of a word is a plain minimum), and repeats until no word has a pair
left; an ordered aggregation lists the ids.  A row is kept as one number, and a round reads the
rows in the order the last one left them, which it checks.  Decoding joins ids with the vocabulary
and concatenates the bytes in order.  Both directions run in one pass over the texts.

Every partition is encoded where it lies, without a shuffle.  The merge table and vocabulary
(about 50,000 tokens, a fixed size) travel with the task.  A worker remembers the ids of about
``REMEMBERED`` words and forgets the older half when there are more.  Words of over ``LONG`` bytes would need as many rounds as bytes, so
they take the same merges from a heap.

Defined results: null counts as empty, an empty text has no tokens; ids decode to exactly the
text's bytes; special tokens are ordinary text; repeated rows encode alike; an empty table
gives an empty result; other columns are passed through.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from crosswitness.llm.common import free_name, table

LONG, REMEMBERED = 400, 800_000  # LONG is under 1024, so a place fits ten bits
#: Bytes of new words per recursive query, bytes of text per slice.
QUERY_BYTES, SLICE_BYTES = 400_000, 1_000_000

#: A row is word, place and token in one number, so it also sorts by word and place.
PLACE, TOKEN = 10, 21
WORD = PLACE + TOKEN

ENCODE = f"""
WITH RECURSIVE parts AS (
  SELECT part, false AS ready FROM bytes_of_words
  UNION ALL
  SELECT part, ready FROM (
    WITH near AS MATERIALIZED (
      SELECT part, part >> {WORD} AS word, lead(part) OVER w AS after, CASE WHEN lag(part) OVER w > part THEN error('out of order') ELSE lag(part) OVER w END AS before
      FROM parts WHERE NOT ready WINDOW w AS ()),
    least AS MATERIALIZED (
      SELECT word, min((merged << {PLACE}) | ((part >> {TOKEN}) & {2 ** PLACE - 1})) AS pick
      FROM near JOIN merges ON pair = ((part & {2 ** TOKEN - 1}) << {TOKEN}) | (after & {2 ** TOKEN - 1}) AND after >> {WORD} = word GROUP BY word)
    SELECT CASE WHEN (part >> {TOKEN}) & {2 ** PLACE - 1} = pick & {2 ** PLACE - 1} THEN ((part >> {TOKEN}) << {TOKEN}) | (pick >> {PLACE}) ELSE part END AS part,
           pick IS NULL AS ready
    FROM near LEFT JOIN least ON least.word = near.word
    WHERE pick IS NULL OR before IS NULL OR before >> {TOKEN} <> (near.word << {PLACE}) | (pick & {2 ** PLACE - 1})))
SELECT part >> {WORD} AS word, list((part & {2 ** TOKEN - 1})::INTEGER ORDER BY part) AS ids FROM parts WHERE ready GROUP BY word ORDER BY word
"""
DECODE = """
SELECT text, string_agg(CASE WHEN earlier > place THEN error('out of order') ELSE latin END, '') AS latin FROM (
  SELECT text, place, latin, lag(place) OVER () AS earlier FROM (SELECT text, place, latin FROM tokens JOIN vocabulary USING (token) ORDER BY place))
GROUP BY text ORDER BY text
"""
#: The same for an engine that does not keep rows in order from step to step.
ENCODE_SORTED = ENCODE.replace("WINDOW w AS ()", "WINDOW w AS (ORDER BY part)")
DECODE_SORTED = "SELECT text, string_agg(latin, '' ORDER BY place) AS latin FROM tokens JOIN vocabulary USING (token) GROUP BY text ORDER BY text"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Codec:
    """One worker's DuckDB tables and remembered words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        vocabulary = pd.DataFrame({"token": np.array(list(ranks.values()), np.int32), "latin": [t.decode("latin-1") for t in ranks]})  # noqa: F841
        self.db.execute("SET enable_progress_bar = false")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.mergeable = False
        self.index: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _merge_table(self) -> None:
        """Made on first use: a worker that only decodes does without."""
        ranks = self.ranks
        cuts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        a, b, merged = np.array(cuts, np.int64).reshape(-1, 3).T
        merges = pd.DataFrame({"pair": (a << TOKEN) | b, "merged": merged})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.mergeable = True

    def _unknown(self, words: dict[str, None]) -> list[str]:
        """The words to learn; makes room for them first."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) <= REMEMBERED or not self.index:
            return new
        first = len(self.index) // 2  # words were learned in the order of their rows
        base = self.ends[first]
        self.index = {w: row - first for w, row in islice(self.index.items(), first, None)}
        self.ids, self.ends = self.ids[base:].copy(), self.ends[first:] - base
        return [w for w in words if w not in self.index]

    def learn(self, words: list[str]) -> None:
        """Encode words that are not remembered yet."""
        got: list[np.ndarray] = [None] * len(words)
        waiting, size = [], 0
        encoded = [w.encode("utf-8", "surrogatepass") for w in words]
        # Words of like length together: a query takes as many rounds as its longest word needs.
        for i in sorted(range(len(words)), key=lambda i: len(encoded[i])):
            data = encoded[i]
            if data in self.ranks:
                got[i] = np.array([self.ranks[data]], np.int32)
            elif len(data) > LONG:
                got[i] = np.array(self._by_heap(data), np.int32)
            else:
                waiting.append((i, data))
                size += len(data)
            if size >= QUERY_BYTES:
                self._contract(waiting, got)
                waiting, size = [], 0
        if waiting:
            self._contract(waiting, got)
        self.index.update(zip(words, range(len(self.ends) - 1, len(self.ends) - 1 + len(words))))
        self.ids = np.concatenate([self.ids, *got])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in got])])

    def _contract(self, waiting: list[tuple[int, bytes]], got: list) -> None:
        if not self.mergeable:
            self._merge_table()
        n = np.array([len(d) for _, d in waiting])
        raw = np.frombuffer(b"".join(d for _, d in waiting), np.uint8)
        word, place = np.repeat(np.arange(len(n)), n), np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
        self.db.register("bytes_of_words", pd.DataFrame({"part": (word << WORD) | (place << TOKEN) | self.bytes[raw]}))
        found = self._ordered(ENCODE, ENCODE_SORTED).column("ids").combine_chunks()
        self.db.unregister("bytes_of_words")
        flat, ends = found.flatten().to_numpy(), found.offsets.to_numpy()
        for k, (i, _) in enumerate(waiting):
            got[i] = flat[ends[k] - ends[0] : ends[k + 1] - ends[0]]

    def _ordered(self, query: str, plain: str):
        """The result of a query that relies on the order of rows and checks it; of the plain one where it does not hold."""
        import duckdb

        try:
            return self.db.sql(query).to_arrow_table()
        except duckdb.Error as e:
            if "out of order" not in str(e):
                raise
            return self.db.sql(plain).to_arrow_table()

    def _by_heap(self, data: bytes) -> list[int]:
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (r := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, len(parts[i]), len(parts[j])))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else len(parts)
            if j >= len(parts) or len(parts[i]) != x or len(parts[j]) != y:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[p] for p in parts if p is not None]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; words are taken a bounded number at a time."""
        words = self.pattern.finditer(text) if len(text) > SLICE_BYTES else iter(self.pattern.findall(text))
        out = []
        while some := list(islice(words, 200_000)):
            some = [m if isinstance(m, str) else m[0] for m in some]
            if new := self._unknown(dict.fromkeys(some)):
                self.learn(new)
            out.append(self._gather(some))
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _gather(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        first, n = self.ends[at], self.ends[at + 1] - self.ends[at]
        total = np.cumsum(n)
        return self.ids[np.repeat(first - (total - n), n) + np.arange(total[-1] if len(total) else 0)]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of several texts: new words of a slice of the texts are learned together."""
        out, at = [], 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE_BYTES):
                size, to = size + len(texts[to]), to + 1
            if size <= SLICE_BYTES:
                cut = [self.pattern.findall(t) for t in texts[at:to]]
                if new := self._unknown(dict.fromkeys(chain.from_iterable(cut))):
                    self.learn(new)
                out += [self._gather(c) for c in cut]
            else:
                out += [self.encode(t) for t in texts[at:to]]
            at = to
        return out

    def decode_all(self, lists: list[np.ndarray]) -> list[bytes]:
        out, at = [b""] * len(lists), 0
        while at < len(lists):
            to, size = at, 0
            while to < len(lists) and (to == at or size + len(lists[to]) <= SLICE_BYTES // 4):
                size, to = size + len(lists[to]), to + 1
            n = np.array([len(x) for x in lists[at:to]])
            flat = np.concatenate([np.asarray(x, np.int32) for x in lists[at:to]])
            rows = pd.DataFrame({"text": np.repeat(np.arange(at, to), n), "place": np.arange(len(flat)), "token": flat})
            self.db.register("tokens", rows)
            found = self._ordered(DECODE, DECODE_SORTED)
            for text, latin in zip(found.column("text").to_pylist(), found.column("latin").to_pylist()):
                out[text] = latin.encode("latin-1")
            self.db.unregister("tokens")
            at = to
        return out


def _slices(rows: pd.DataFrame, sizes: list[int]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of about a slice's size together, or one larger row."""
    first = size = 0
    for i, n in enumerate(sizes):
        if i > first and size + n > SLICE_BYTES:
            yield rows.iloc[first:i]
            first, size = i, 0
        size += n
    if first < len(rows):
        yield rows.iloc[first:]


_codecs: dict[tuple, Codec] = {}


def _codec(name: tuple, ranks: dict[bytes, int], pattern: str) -> Codec:
    """This worker's codec; workers serve many tasks."""
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(ranks, pattern)
    return _codecs[name]


class ByteBpe:
    """Encoder and decoder of a rank file; ``path`` and ``pattern`` say which."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.name, self.pattern = (path, pattern), pattern
        self.ranks = spark.sparkContext.broadcast(read_ranks(path))  # a vocabulary: its size is fixed

    def encode(self, docs: DataFrame, text: str = "text", into: str = "ids") -> DataFrame:
        """The table with a column of token ids."""
        ranks, pattern, name = self.ranks, self.pattern, self.name

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codec = _codec(name, ranks.value, pattern)
            for b in batches:
                for part in _slices(b, [len(t or "") for t in b[text]]):
                    yield part.assign(**{into: codec.encode_all([t or "" for t in part[text]])})

        return docs.mapInPandas(run, StructType([*docs.schema.fields, StructField(into, ArrayType(IntegerType()))]))

    def decode(self, rows: DataFrame, ids: str = "ids", into: str = "decoded") -> DataFrame:
        """The table with a column of the bytes that the ids stand for."""
        ranks, pattern, name = self.ranks, self.pattern, self.name

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codec = _codec(name, ranks.value, pattern)
            for b in batches:
                for part in _slices(b, [0 if x is None else 4 * len(x) for x in b[ids]]):
                    lists = [np.zeros(0, np.int32) if x is None else x for x in part[ids]]
                    yield part.assign(**{into: codec.decode_all(lists)})

        return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(into, BinaryType())]))

    def both(self, docs: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
        """The table with the token ids and the bytes decoded from them, by one worker a task."""
        ranks, pattern, name = self.ranks, self.pattern, self.name

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            codec = _codec(name, ranks.value, pattern)
            for b in batches:
                for part in _slices(b, [len(t or "") for t in b[text]]):
                    lists = codec.encode_all([t or "" for t in part[text]])
                    yield part.assign(**{ids: lists, decoded: codec.decode_all(lists)})

        return docs.mapInPandas(run, StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(decoded, BinaryType())]))


def standard(spark: SparkSession) -> ByteBpe:
    import public_tokenizers

    return ByteBpe(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(spark: SparkSession, docs: DataFrame, bpe: ByteBpe | None = None) -> DataFrame:
    """The query's columns."""
    bpe = bpe or standard(spark)
    rows = bpe.both(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def round_trip(spark: SparkSession, docs: DataFrame, bpe: ByteBpe | None = None) -> DataFrame:
    """The documents with token ids, and the text as decoded from them."""
    bpe = bpe or standard(spark)
    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    return bpe.both(docs, ids=ids, decoded=decoded)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
SQL = {}
