"""Words and word shingles of UTF-8 texts as 64-bit hashes, a batch at a time.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D after lower-casing A-Z,
which is the same on bytes as on characters. A shingle is five words in a row; a
text of one to four words has its whole sequence as its one shingle; a text
without words has none. A word is hashed eight bytes at a time, each block scrambled with its place before they are
added, so that no arrangement of bytes (as in the Thue-Morse words, on which sums of powers modulo 2^64 fail) makes words collide. Hashes
are 64 bits wide: among 10^9 different shingles of compared documents a collision has a chance below one in thirty.
"""

from __future__ import annotations

import numpy as np

from .common import mixed, steps

WIDTH = 5

_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_PLACE = mixed(np.arange(1, WIDTH + 2, dtype=np.uint64)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and their inverses."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        n = max(n, len(_POWERS) + (1 << 18))
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS = np.full(n, _BASE, np.uint64)
        _INVERSES = np.full(n, inverse, np.uint64)
        _POWERS[0] = _INVERSES[0] = 1
        np.multiply.accumulate(_POWERS, out=_POWERS)
        np.multiply.accumulate(_INVERSES, out=_INVERSES)
    return _POWERS[:n], _INVERSES[:n]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def block_hashes(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the strings flat[begin : begin + size], of their bytes and sizes alone."""
    padded = np.concatenate((flat, np.zeros(8, np.uint8)))
    words = np.ndarray((len(flat) + 1,), "<u8", padded, strides=(1,))
    h = mixed((words[begin] & _MASKS.take(np.minimum(size, 8))) ^ np.uint64(_BASE))
    far = np.flatnonzero(size > 8)
    if len(far):
        more = (size[far] - 1) >> 3
        ends = np.cumsum(more)
        block = np.arange(1, ends[-1] + 1) - np.repeat(ends - more, more)
        at = np.repeat(begin[far], more) + 8 * block
        left = np.repeat(size[far], more) - 8 * block
        x = words[at] & _MASKS.take(np.minimum(left, 8))
        h[far] += np.add.reduceat(mixed(x ^ mixed(block.astype(np.uint64) + np.uint64(_BASE))), ends - more)
    return mixed(h + size.astype(np.uint64))


def word_hashes(flat: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows that lie one after another, and the first word of each row (n + 1).
    gap says of each byte whether it parts words."""
    n = len(flat)
    firsts = np.zeros(len(offsets), np.int64)
    if not n:
        return np.zeros(0, np.uint64), firsts
    solid = ~gap[flat]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = block_hashes(LOWER[flat], s, e - s)
    return h, np.searchsorted(s, offsets)


def shingle_hashes(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles in text order, and the first shingle of each row (n + 1)."""
    counts = np.diff(firsts)
    many = np.where(counts >= WIDTH, counts - WIDTH + 1, (counts > 0).astype(np.int64))
    starts = np.zeros(len(firsts), np.int64)
    np.cumsum(many, out=starts[1:])
    out = np.empty(starts[-1], np.uint64)
    if len(words) >= WIDTH:
        total = len(words) - WIDTH + 1
        h = words[:total] * _PLACE[0]
        for k in range(1, WIDTH):
            h = h + words[k : k + total] * _PLACE[k]
        row = np.repeat(np.arange(len(counts)), np.where(counts >= WIDTH, many, 0))
        if len(row):
            at = np.arange(len(row)) - np.repeat(np.cumsum(np.where(counts >= WIDTH, many, 0)) - np.where(counts >= WIDTH, many, 0), np.where(counts >= WIDTH, many, 0))
            out[starts[row] + at] = mixed(h[firsts[row] + at])
    for i in np.flatnonzero((counts > 0) & (counts < WIDTH)):
        own = words[firsts[i] : firsts[i + 1]]
        whole = (own * _PLACE[: len(own)]).sum(dtype=np.uint64, keepdims=True)
        out[starts[i]] = mixed(whole + _PLACE[WIDTH : WIDTH + 1] * len(own))[0]
    return out, starts


def row_shingles(flat: np.ndarray, offsets: np.ndarray):
    """(row, shingle hashes in text order) of each row of a batch."""
    for i, j in steps(offsets):
        own = offsets[i : j + 1] - offsets[i]
        hashes, starts = shingle_hashes(*word_hashes(flat[offsets[i] : offsets[j]], own))
        for r in range(j - i):
            yield i + r, hashes[starts[r] : starts[r + 1]]


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(hashes) < 2:
        return hashes
    s = np.sort(hashes)
    keep = np.empty(len(s), bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]
