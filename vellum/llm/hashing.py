"""Vectorised word and word-window hashes over the bytes of an Arrow text column.

Word hash: sum of T[byte] * r^position over the word (arithmetic modulo 2^64), read off a
prefix sum, then mixed with the word's length. Window hash: the same construction over word
hashes. Both are functions of the content alone, so equal words and windows agree across
documents, tasks and runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from vellum.llm.common import bytes_of

U = np.uint64
#: Bytes that are hashed at a time: what a processor's cache holds of their sums.
_BLOCK = 1 << 16
#: Words above this many bytes are hashed one by one.
LONG_WORD = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64's finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_RADIX = [0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1]
_INVERSE = [pow(r, -1, 1 << 64) for r in _RADIX]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(radix: int, n: int, inverse: bool = False) -> np.ndarray:
    """r^0 .. r^(n-1) modulo 2^64."""
    have = _powers.get((radix, inverse))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        base = np.full(size, (_INVERSE if inverse else _RADIX)[radix], U)
        base[0] = 1
        have = np.cumprod(base, dtype=U)
        if size <= 1 << 22:
            _powers[(radix, inverse)] = have
    return have[:n]


_PLAIN = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


@dataclass
class Words:
    """Words of a batch: ``hash[i]`` is the i-th word's, ``start``/``end`` its bytes in
    ``data``; document d has the words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    doc_offsets: np.ndarray


def words(col: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Words of every text of a string column (split at ASCII white space; nulls have none).
    ``lower``: A-Z count as a-z. ``plain``: the whole text is lower-cased and split at everything
    in ASCII that is no letter or digit."""
    data, offsets = bytes_of(pc.utf8_lower(col) if plain else col)
    if lower and len(data):
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U), np.zeros(len(offsets), np.int64), offsets)
    inside = _PLAIN[data] if plain else ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    ends[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets).astype(np.int64)
    return Words(data, start, end, _hash_words(data, start, end), first, offsets)


_T = _table(1)


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), U)
    size = end - start
    w = 0
    while w < len(start):
        stop = max(w + 1, int(np.searchsorted(end, start[w] + _BLOCK, side="right")))
        if size[w] > LONG_WORD:
            out[w] = xxhash.xxh64_intdigest(data[start[w]:end[w]].tobytes())
            w += 1
            continue
        lo, hi = start[w], end[stop - 1]
        total = np.empty(hi - lo + 1, U)
        total[0] = 0
        np.cumsum(_T[data[lo:hi]] * powers(0, hi - lo), dtype=U, out=total[1:])
        s, e = start[w:stop] - lo, end[w:stop] - lo
        out[w:stop] = (total[e] - total[s]) * powers(0, hi - lo + 1, True)[s]
        for k in np.flatnonzero(size[w:stop] > LONG_WORD):
            out[w + k] = xxhash.xxh64_intdigest(data[start[w + k]:end[w + k]].tobytes())
        w = stop
    return mix(out ^ (size.astype(U) * U(0xC2B2AE3D27D4EB4F)))


def prefix(values: np.ndarray, radix: int = 1) -> np.ndarray:
    """Prefix sums of ``values[i] * r^i``; one longer than ``values``."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * powers(radix, len(values)), dtype=U, out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray, radix: int = 1) -> np.ndarray:
    """Hashes of the word ranges [start, end), from ``prefix``; the length takes part."""
    if not len(start):
        return np.zeros(0, U)
    raw = (sums[end] - sums[start]) * powers(radix, len(sums), True)[start]
    return mix(raw ^ ((end - start).astype(U) * U(0x165667B19E3779F9)))


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every place where a k-word window of one document starts, and its document."""
    count = np.maximum(0, np.diff(first) - k + 1)
    doc = np.repeat(np.arange(len(count)), count)
    base = np.concatenate([[0], np.cumsum(count)])[:-1]
    return first[doc] + np.arange(len(doc)) - base[doc], doc


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out
