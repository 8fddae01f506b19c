"""Vectorised words and shingles of Arrow string arrays.

Words get 64-bit tabulation hashes of their bytes (A-Z lower-cased) without any
Python string being made.  All tables come from a fixed seed, so every worker
and every rerun computes the same values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(0, 2**64, size=64 * 256, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, size=64, dtype=np.uint64) * U64(2) + U64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes handled at once; longer texts are cut at a space, so memory stays bounded.
_PIECE = 4 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that near values part."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(29)
    h = h * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


@dataclass
class Words:
    hash: np.ndarray  #: uint64 for each word
    first: np.ndarray  #: index of each document's first word, with the end appended
    start: np.ndarray  #: byte offsets of each word in ``data``
    end: np.ndarray
    data: np.ndarray  #: the bytes of all documents

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[off[0] : off[-1]], off - off[0]


def _hash_piece(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    total = int(size.sum())
    first = np.cumsum(size) - size
    pos = np.arange(total, dtype=np.int64) - np.repeat(first, size)
    byte = _FOLD[b[pos + np.repeat(starts, size)]].astype(np.int64)
    value = _TABLE[((pos & 63) << 8) | byte]
    if size.max() > 64:
        value *= (pos >> 6).astype(np.uint64) * U64(2) + U64(1)
    return mix(np.add.reduceat(value, first))


#: All ASCII but letters and digits parts words, so that punctuation does not stick to them.
BARE = _SPACE | ~np.array([c >= 128 or chr(c).isalnum() for c in range(256)])


def words(texts: pa.Array, space: np.ndarray = _SPACE) -> Words:
    """``texts``: a large_string array without nulls; ``space``: the bytes that part words."""
    b, off = _buffer(texts)
    n = len(b)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64), none, none, b)
    solid = ~space[b]
    s, e = solid.copy(), solid.copy()
    s[1:] &= ~solid[:-1]
    e[:-1] &= ~solid[1:]
    full = np.diff(off) > 0
    s[off[:-1][full]] = solid[off[:-1][full]]
    e[off[1:][full] - 1] = solid[off[1:][full] - 1]
    start, end = np.flatnonzero(s), np.flatnonzero(e) + 1
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _PIECE, side="right")))
        out[at:to] = _hash_piece(b, start[at:to], end[at:to])
        at = to
    return Words(out, np.searchsorted(start, off), start, end, b)


def shingles(w: Words, size: int, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows in order and each document's first
    index (end appended).  With ``short_whole`` a shorter document that has words
    gives its whole sequence as one shingle, else none."""
    n = w.counts
    many = np.maximum(n - size + 1, 0)
    short = (n > 0) & (n < size)
    if short_whole:
        many = many + short
    first = np.concatenate(([0], np.cumsum(many)))
    out = np.zeros(int(first[-1]), U64)
    if not len(out):
        return out, first
    doc = np.repeat(np.arange(len(n)), many)
    at = np.arange(len(out)) - first[doc] + w.first[doc]
    stop = w.first[doc + 1]
    for i in range(size):
        here = at + i
        inside = here < stop
        if inside.all():
            out += w.hash[here] * _ODD[i]
        else:
            out[inside] += w.hash[here[inside]] * _ODD[i]
    if short_whole and short.any():
        out[first[:-1][short]] += n[short].astype(np.uint64) * _ODD[-1]
    return mix(out), first


def distinct_sorted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct hashes in ascending order, and the first indexes."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h = h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate(([0], np.cumsum(np.bincount(doc[keep], minlength=len(n))[: len(n)])))
