"""Words of Arrow text columns as numpy arrays: byte offsets and 64-bit hashes, without a Python loop over words.

A batch's texts are one byte buffer. A word is a maximal run of word bytes that does not cross a text boundary; all
word definitions of this package are unions of byte values, so UTF-8 needs no decoding.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that end a word in ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased: digits, letters, everything beyond ASCII.
ALNUM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM[_low:_high] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (full avalanche); works in place on its own copy."""
    h = h.copy()
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@lru_cache(maxsize=4)
def _byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(16, int(n - 1).bit_length())
    return _powers(base, size)[:n]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and validity of a string column of one record batch."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_string())
    n = len(arr)
    valid = np.ones(n, bool) if arr.null_count == 0 else np.asarray(arr.is_valid())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, arr.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if arr.null_count:  # a null may keep bytes behind it
        size = np.where(valid, np.diff(off), 0)
        if size.sum() != off[-1]:
            keep = np.repeat(valid, np.diff(off))
            raw = raw[keep]
            off = np.concatenate([[0], np.cumsum(size)])
    return raw, off, valid


@dataclass
class Words:
    """All words of a batch, in order. ``first[i]:first[i + 1]`` are the words of text i."""

    start: np.ndarray  # byte where a word starts
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray, hashed: bool = True, seed: int = 11) -> Words:
    """Words of every text. Hashes are those of the given bytes: map case before, if it should not count."""
    inside = is_word[raw]
    edge = np.empty(len(raw) + 1, bool)
    edge[0] = True if len(raw) else False
    edge[-1] = False
    edge[1:-1] = ~inside[:-1]
    inner = off[(off > 0) & (off < len(raw))]
    edge[inner] = True
    start = np.flatnonzero(inside & edge[:-1])
    closed = np.empty(len(raw), bool)
    if len(raw):
        closed[:-1] = ~inside[1:]
        closed[-1] = True
        closed[inner - 1] = True
    end = np.flatnonzero(inside & closed) + 1
    first = np.searchsorted(start, off)
    return Words(start, end, first, word_hashes(raw, start, end, seed) if hashed else None)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 11, block: int = 1 << 20) -> np.ndarray:
    """Hash of each slice of the buffer, from prefix sums of a polynomial in an odd base modulo 2^64."""
    out = np.empty(len(start), np.uint64)
    code = _byte_codes(seed)
    lo = 0
    while lo < len(start):  # blocks that end at a word's end, so that tables stay small
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + block, "right")))
        a, b = int(start[lo]), int(end[hi - 1])
        up, down = powers(BASE, b - a), powers(INVERSE, b - a)
        prefix = np.zeros(b - a + 1, np.uint64)
        np.cumsum(code[raw[a:b]] * up, out=prefix[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        out[lo:hi] = (prefix[e] - prefix[s]) * down[s]
        lo = hi
    return mix(out)


def windows(h: np.ndarray, size: int, salt: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """Hash of every ``size`` consecutive entries (one for each start; crossing text ends, see ``inside``)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    k = U64(salt | 1)
    for j in range(size):
        out *= k
        out += h[j:j + n]
    return mix(out)


def window_starts(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """Mask over window starts 0..total-size: the window lies in one text."""
    n = total - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    left = np.repeat(first[1:], np.diff(first))[:n]  # where the text of each word ends
    return np.arange(n) + size <= left


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cover(marks: np.ndarray, size: int) -> np.ndarray:
    """Words covered by the marked windows (marks: one flag per word, true where a window starts)."""
    step = np.zeros(len(marks) + size + 1, np.int64)
    np.add.at(step, np.flatnonzero(marks), 1)
    np.add.at(step, np.flatnonzero(marks) + size, -1)
    return np.cumsum(step)[:len(marks)] > 0
