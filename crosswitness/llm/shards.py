"""Word streams in slices, and lossless counts of word n-grams in shards.

A *slice* is about a million words of neighbouring texts, with its own small dictionary.  A
*shard* owns a part of the words or n-grams by hash.  Slices send each shard their distinct words
or n-grams with counts, once each and packed, so the most frequent word or n-gram of the corpus is one entry a slice; shards
answer slices the same way.  Nothing is sent to the driver but totals.

:class:`QuotientFilter` is the counting quotient filter of one (slice, shard): packed ids are
permuted invertibly, the upper bits (the quotient) become a position, the lower bits (the
remainder) are stored in full, so the counts are exact and the ids come back.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crosswitness.llm.common import write_table

SLICE_WORDS = 1_000_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A byte that UTF-8 never uses; as a token it ends a text or a piece of one.
END = b"\xff"

#: A row with shard -1 holds a slice's texts; the others hold its words, one row a shard.
SLICES = ("slice long, part string, shard int, n_words long, n_counted long, doc_ids array<string>, counted binary, tokens binary, "
          "shard_of binary, words binary, counts binary")
TOTALS = "slice long, part string, shard int, ids binary, counts binary, word string, f long, id long, numbers array<long>"

_U = np.uint64
_STIR = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def pack(numbers: np.ndarray) -> bytes:
    """Fixed-width numbers as compressed byte planes."""
    a = np.ascontiguousarray(numbers)
    return zstandard.ZstdCompressor(3).compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_counts(numbers: np.ndarray) -> bytes:
    """Whole numbers from zero on, in the narrowest width that holds them; the first byte says which."""
    top = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + pack(numbers.astype(f"u{width}"))


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"u{data[0]}").astype(np.int64)


def distinct(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts, or the sums of their weights."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")  # merges the sorted stretches
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights[order], first)


class QuotientFilter:
    """Counts of packed ids of ``bits`` bits in one of ``2 ** shard_bits`` shards."""

    def __init__(self, bits: int, shard_bits: int, keys: np.ndarray, counts: np.ndarray):
        self.bits, self.shard_bits, self.keys, self.counts = bits, shard_bits, keys, counts  # permuted keys, rising

    @staticmethod
    def permute(packed: np.ndarray, bits: int) -> np.ndarray:
        mask, half, x = _U(2**bits - 1), _U((bits + 1) // 2), packed.astype(_U)
        for stir in _STIR:
            x = x ^ (x >> half)
            x = (x * _U(stir)) & mask
        return x ^ (x >> half)

    @staticmethod
    def restore(permuted: np.ndarray, bits: int) -> np.ndarray:
        mask, half = _U(2**bits - 1), _U((bits + 1) // 2)
        x = permuted ^ (permuted >> half)
        for stir in reversed(_STIR):
            x = (x * _U(pow(stir, -1, 2**64))) & mask
            x = x ^ (x >> half)
        return x

    @classmethod
    def of_shards(cls, packed: np.ndarray, bits: int, shard_bits: int) -> Iterator[tuple[int, QuotientFilter]]:
        """The filters of the occurrences, one for each shard that has any."""
        keys, counts = distinct(cls.permute(packed, bits))
        shard = (keys >> _U(bits - shard_bits)).astype(np.int64) if shard_bits else np.zeros(len(keys), np.int64)
        cut = np.searchsorted(shard, np.arange((1 << shard_bits) + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            yield s, cls(bits, shard_bits, keys[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]])

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter of the sums; the sorted keys of the filters are merged."""
        keys, counts = distinct(np.concatenate([f.keys for f in filters]), np.concatenate([f.counts for f in filters]))
        return cls(filters[0].bits, filters[0].shard_bits, keys, counts)

    def packed(self) -> np.ndarray:
        return self.restore(self.keys, self.bits)

    def to_bytes(self) -> bytes:
        """Run length of every quotient, remainders in full, counters."""
        local = self.bits - self.shard_bits
        q = min(local, max(0, len(self.keys).bit_length() - 1))
        shard = int(self.keys[0] >> _U(local)) if self.shard_bits and len(self.keys) else 0
        low = self.keys & _U(2**local - 1)
        rest = _U(local - q)
        runs = np.bincount((low >> rest).astype(np.int64), minlength=1 << q) if q else np.array([len(low)])
        parts = pack_counts(runs), pack_counts(low & _U(2 ** int(rest) - 1)), pack_counts(self.counts)
        return struct.pack("<BBBQ3I", self.bits, self.shard_bits, q, shard, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        head = "<BBBQ3I"
        bits, shard_bits, q, shard, a, b, c = struct.unpack_from(head, data)
        at = struct.calcsize(head)
        local = bits - shard_bits
        runs = unpack_counts(data[at : at + a])
        low = unpack(data[at + a + 1 : at + a + b], f"u{data[at + a]}").astype(_U)
        quotient = np.repeat(np.arange(len(runs), dtype=_U), runs)
        keys = (_U(shard) << _U(local) if shard_bits else _U(0)) | (quotient << _U(local - q) if q else _U(0)) | low
        return cls(bits, shard_bits, keys, unpack_counts(data[at + a + b : at + a + b + c]))


class _Slice:
    """What one part (a language, say) adds to the slice being filled."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {END: 0}
        self.ids, self.counted, self.streams = [], [], []

    def add(self, doc_id, counted: bool, tokens: list[bytes]) -> int:
        get, number = self.number.setdefault, self.number
        self.streams.append(np.array([get(t, len(number)) for t in tokens], np.uint32))
        self.ids.append(doc_id)
        self.counted.append(counted)
        return len(tokens)

    def rows(self, slice_: int, part: str, shards: int) -> Iterator[tuple]:
        tokens = np.concatenate(self.streams)
        n = len(self.number)
        # Frequent words get small numbers, which pack better.
        rank = np.zeros(n, np.uint32)
        order = np.argsort(-np.bincount(tokens, minlength=n)[1:], kind="stable") + 1
        rank[order] = np.arange(1, n, dtype=np.uint32)
        mine = np.repeat(np.array(self.counted, bool), [len(x) for x in self.streams])
        counts = np.bincount(tokens[mine], minlength=n)[order]
        words = list(self.number)
        words = [words[i] for i in order]
        of = np.fromiter((zlib.crc32(w) % shards for w in words), np.uint32, n - 1)
        yield (slice_, part, -1, int(np.count_nonzero(tokens)), sum(self.counted), self.ids, pack(np.array(self.counted, np.uint8)),
               pack(rank[tokens]), pack_counts(of), None, None)
        for at in by_value(of):
            yield (slice_, part, int(of[at[0]]), 0, 0, None, None, None, None,
                   zstandard.ZstdCompressor(3).compress(b"\n".join([words[i] for i in at])), pack_counts(counts[at]))


def by_value(values: np.ndarray) -> list[np.ndarray]:
    """The places of each distinct value, in rising order."""
    order = np.argsort(values, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(values[order])) + 1) if len(order) else []


def cut(docs: DataFrame, tokens_of: Callable[[bytes], list[bytes]], path: str) -> DataFrame:
    """The written slices of a table (doc_id, text, part, counted).

    ``tokens_of`` lists the words of a UTF-8 text, which hold no line feed, and ends with
    :data:`END`.  Numbers in ``tokens`` count a slice's words from 1; 0 is :data:`END`.  Only
    texts with ``counted`` count.
    """
    names = [f.split()[0] for f in SLICES.split(", ")]
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slice_, size, parts = TaskContext.get().partitionId() << 32, 0, {}

        def rows() -> pd.DataFrame:
            nonlocal slice_
            out = []
            for part, s in parts.items():
                out += s.rows(slice_, part, shards)
                slice_ += 1
            return pd.DataFrame(out, columns=names)

        for b in batches:
            for doc_id, text, part, counted in zip(b["doc_id"], b["text"], b["part"], b["counted"]):
                tokens = tokens_of((text or "").encode("utf-8", "replace"))
                size += parts.setdefault(part, _Slice()).add(doc_id, bool(counted), tokens)
                if size >= SLICE_WORDS:
                    yield rows()
                    size, parts = 0, {}
        if parts:
            yield rows()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "part", "counted")  # beside nulls, pandas rounds large numbers
    return write_table(texts.mapInPandas(run, StructType.fromDDL(SLICES)), path)


def word_totals(slices: DataFrame, path: str, least: int = 0, listed: bool = False) -> DataFrame:
    """The written totals of all words, by shard.

    Rows with a slice hold the numbers and total counts of that slice's words of the shard, in
    its own order; words counted less than ``least`` times have number 0, others unique ones from
    1 on.  Rows with ``numbers`` hold (largest number, sum of counts, words counted, words counted
    once, twice, ... six times).  With ``listed`` every numbered word has a row (part, word, f, id).
    """
    shards = int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in TOTALS.split(", ")]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        sent = [zstandard.ZstdDecompressor().decompress(w).split(b"\n") for w in rows["words"]]
        total: dict[str, dict[bytes, int]] = {}
        for part, words, counts in zip(rows["part"], sent, rows["counts"]):
            mine = total.setdefault(part, {})
            for w, c in zip(words, unpack_counts(counts).tolist()):
                mine[w] = mine.get(w, 0) + c
        number, top, out = {}, 0, []
        for part, mine in total.items():
            often = [w for w, f in mine.items() if f >= least]
            number[part] = dict(zip(often, range(top * shards + shard + 1, (top + len(often)) * shards + shard + 1, shards)))
            top += len(often)
            if listed:
                out += [(None, part, shard, None, None, w.decode("utf-8"), mine[w], i, None) for w, i in number[part].items()]
        for slice_, part, words in zip(rows["slice"], rows["part"], sent):
            of, f = number[part], total[part]
            ids = np.array([of.get(w, 0) for w in words], np.int64)
            out.append((slice_, part, shard, pack_counts(ids), pack_counts(np.array([f[w] for w in words], np.int64)), None, None, None, None))
        every = np.array([f for mine in total.values() for f in mine.values()], np.int64)
        stats = [max((i for of in number.values() for i in of.values()), default=0), int(every.sum()), int(np.count_nonzero(every)),
                 *[int(np.count_nonzero(every == r)) for r in range(1, 7)]]
        out.append((None, None, shard, None, None, None, None, None, stats))
        return pd.DataFrame(out, columns=names)

    return write_table(slices.where("shard >= 0").groupBy("shard").applyInPandas(run, TOTALS), path)


def told_to(shard_of: bytes, answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and total counts of a slice's words, from the answers of all shards; place 0 is left for :data:`END`."""
    of = unpack_counts(shard_of)
    ids, counts = np.zeros(len(of) + 1, np.int64), np.zeros(len(of) + 1, np.int64)
    said = {int(s): (i, c) for s, i, c in zip(answers["shard"], answers["ids"], answers["counts"])}
    for at in by_value(of):
        i, c = said[int(of[at[0]])]
        ids[at + 1], counts[at + 1] = unpack_counts(i), unpack_counts(c)
    return ids, counts


def largest(df: DataFrame, column: str) -> int:
    """One number to the driver."""
    return int(df.agg(F.max(column)).first()[0] or 0)


def shard_bits(entries: int, per_shard: int) -> int:
    """As many shards as keep one at about ``per_shard`` entries."""
    return max(0, int(np.ceil(np.log2(max(1, entries / per_shard)))))
