"""First digits of very many md5 digests in numpy: the texts of one length differ in their beginnings, every draw appends its own ending."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

U32 = np.uint32
MASK = 0xFFFFFFFF
#: The constants of RFC 1321.
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
ADD = [int(abs(math.sin(i + 1)) * 2**32) & MASK for i in range(64)]
TURN = [U32(x) for x in [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4]
BACK = [U32(32 - int(x)) for x in TURN]
WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
FIRST = 61  # steps after which the register of the first digits is final
LANES = 24576  # texts at a time: their registers stay in a processor's cache


def _lanes(k: int, n: int) -> list[np.ndarray]:
    """``k`` arrays of ``n`` numbers, each beginning at a cache line."""
    wide = -(-n // 16) * 16
    block = np.empty(k * wide + 16, U32)
    at = -block.ctypes.data % 64 // 4
    return [block[at + i * wide:at + i * wide + n] for i in range(k)]


def _set(to: list[np.ndarray], values: Sequence) -> list[np.ndarray]:
    for x, v in zip(to, values):
        x[:] = v
    return to


def _steps(state: list[np.ndarray], words: Sequence, lo: int, hi: int, t: np.ndarray, u: np.ndarray) -> list[np.ndarray]:
    """Steps ``lo`` to ``hi`` of one block, in place; a word is an array, or a number that all texts share."""
    a, b, c, d = state
    for i in range(lo, hi):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        w = words[WORD[i]]
        if isinstance(w, np.ndarray):
            np.add(t, w, out=t)
            w = 0
        np.add(t, U32(w + ADD[i] & MASK), out=t)
        np.left_shift(t, TURN[i], out=u)
        np.right_shift(t, BACK[i], out=t)
        np.bitwise_or(t, u, out=t)
        np.add(t, b, out=a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def first_numbers(heads: np.ndarray, endings: Sequence[bytes]) -> Iterator[np.ndarray]:
    """For each ending, the first four bytes (little-endian) of the md5 of every row of ``heads`` (texts x bytes) with it."""
    n, size = heads.shape
    whole = size // 64
    head = np.zeros((n, 64 * (whole + 1)), np.uint8)
    head[:, :size] = heads
    columns = _set(_lanes(16 * (whole + 1), n), head.view("<u4").T)
    (t, u, joint), state, begin, shared, now = _lanes(3, n), _set(_lanes(4, n), START), _lanes(4, n), _lanes(4, n), _lanes(4, n)
    for k in range(whole):  # blocks that hold no ending: once for all of them
        for x, y in zip(state, _steps(_set(now, state), columns[16 * k:16 * k + 16], 0, 64, t, u)):
            x += y
    rest, left = columns[16 * whole:], size - 64 * whole
    full = left // 4  # words that no ending touches
    shared = _steps(_set(shared, state), [*rest[:full], *[0] * (16 - full)], 0, full, t, u)
    for ending in endings:
        tail = bytes(left) + ending + b"\x80"
        tail += bytes(-(len(tail) + 8) % 64) + (8 * (size + len(ending)) % 2**64).to_bytes(8, "little")
        words: list = [int(x) for x in np.frombuffer(tail, "<u4")]
        words[:full] = rest[:full]
        if left % 4:
            words[full] = np.bitwise_or(rest[full], U32(words[full]), out=joint)
        now = _steps(_set(now, shared), words[:16], full, FIRST if len(words) == 16 else 64, t, u)
        _set(begin, state)
        for k in range(16, len(words), 16):
            for x, y in zip(begin, now):
                x += y
            now = _steps(_set(now, begin), words[k:k + 16], 0, FIRST if k + 16 == len(words) else 64, t, u)
        yield np.add(begin[0], now[1])


def counted(edges: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The table for ``counts``: how many of the rising ``edges`` the first two bytes settle, 255 where the other two decide."""
    edge = np.array(edges, np.int64)
    high = np.arange(65536, dtype=np.int64) << 16
    low, up = np.searchsorted(edge, high, "right"), np.searchsorted(edge, high + 65535, "right")
    return edge, np.where(low == up, low, 255).astype(np.uint8)[np.arange(65536, dtype=np.uint16).byteswap()]


def counts(numbers: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many edges the first eight digits reach, for numbers of ``first_numbers``."""
    edge, settled = table
    out = settled[(numbers & U32(0xFFFF)).astype(np.uint16)]
    open_ = np.flatnonzero(out == 255)
    if len(open_):
        out[open_] = np.searchsorted(edge, numbers[open_].byteswap().astype(np.int64), "right")
    return out
