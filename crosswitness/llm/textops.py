"""Numpy helpers for the texts of one Arrow batch: words, word hashes, shingle hashes.

A word is a run of letters, digits or non-ASCII characters after A-Z are lower-cased.  Texts are
taken whole; work arrays cover about a megabyte at a time, however long a text is.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SLICE = 1 << 20

LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[:0x30] = IS_WORD[0x3A:0x61] = IS_WORD[0x7B:0x80] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), wrapping."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_tables: dict[str, np.ndarray] = {}


def _tabled(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, _SLICE + 4096)
        _tables.update(up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    return _tables["up"], _tables["down"]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a UTF-8 text, in order."""
    raw = LOWERED[np.frombuffer(data, dtype=np.uint8)]
    inside = IS_WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    out = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + _SLICE, side="right")))
        hi = int(ends[to - 1])
        up, down = _tabled(hi - lo)
        total = np.concatenate((np.zeros(1, _U), np.cumsum((raw[lo:hi].astype(_U) + _U(1)) * up[: hi - lo], dtype=_U)))
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
        at = to
    return out, starts, ends


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all runs of k words; a text of fewer words, but not none, is one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=_U)
    for i in range(k):
        out = mix(out * _U(_BASE) + hashes[i : n - k + 1 + i])
    return out


def family(hashes: np.ndarray, k: int = 5) -> int:
    """Smallest shingle hash: alike for near copies, different for most other texts."""
    s = shingles(hashes, k)
    return int(s.min().astype(np.int64)) if len(s) else 0
