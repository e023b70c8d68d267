"""Suffix arrays by induced sorting, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The
leftmost-S substrings are sorted by one induction, named, and their order is found
recursively on the names; from it two linear scans, bucket by bucket, induce the order of all
suffixes. A scan handles a whole bucket at once, which needs few distinct
symbols: texts of names beyond ``NARROW`` distinct ones are ranked by doubling instead of
another scan. Common prefixes are computed in text order (permuted), up to a cap."""

from __future__ import annotations

import numpy as np

NARROW = 2048


def _s_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last (the sentinel) is."""
    n = len(t)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    step[-1] = 1
    at = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _push(sa: np.ndarray, heads: np.ndarray, items: np.ndarray, symbols: np.ndarray, down: bool) -> None:
    """Put items, in order, at the fronts (or, down, the backs) of their symbols' buckets."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    count = np.diff(np.append(first, len(s)))
    rank = np.arange(len(s)) - np.repeat(first, count)
    if down:
        sa[heads[s] - 1 - rank] = items[order]
        heads[s[first]] -= count
    else:
        sa[heads[s] + rank] = items[order]
        heads[s[first]] += count


def _induced(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of all suffixes, induced from seeds: leftmost-S positions in their order."""
    n, ends = len(t), np.cumsum(sizes)
    begins = ends - sizes
    sa = np.full(n, -1, np.int64)
    # The seeds wait at the back of their buckets for the scan that places the L suffixes.
    back = ends.copy()
    _push(sa, back, seeds[::-1], t[seeds[::-1]], True)
    head = begins.copy()
    for c in np.flatnonzero(sizes):
        at = begins[c]
        while at < head[c]:
            part = sa[at : head[c]]
            at = head[c]
            before = part[part > 0] - 1
            before = before[~is_s[before]]
            if len(before):
                _push(sa, head, before, t[before], False)
        part = sa[back[c] : ends[c]]
        before = part[part > 0] - 1
        before = before[~is_s[before]]
        if len(before):
            _push(sa, head, before, t[before], False)
    # Now the S suffixes, from the back; the seeds are placed anew.
    tail = ends.copy()
    for c in np.flatnonzero(sizes)[::-1]:
        at = ends[c]
        if c == 0:
            sa[0] = n - 1
            continue
        while tail[c] < at:
            part = sa[tail[c] : at][::-1]
            at = tail[c]
            before = part[part > 0] - 1
            before = before[is_s[before]]
            if len(before):
                _push(sa, tail, before, t[before], True)
        part = sa[begins[c] : head[c]][::-1]
        before = part[part > 0] - 1
        before = before[is_s[before]]
        if len(before):
            _push(sa, tail, before, t[before], True)
    return sa


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a text of many names: ranks by twice as many names each time."""
    n, width = len(names), 1
    rank = names.astype(np.int64)
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        fresh = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        width *= 2


def _named(t: np.ndarray, ordered: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """A name for each leftmost-S substring in their order; equal substrings share one."""
    length = nexts[ordered]
    fresh = np.ones(len(ordered), bool)
    pair = np.flatnonzero(length[1:] == length[:-1]) + 1
    a, b, left = ordered[pair - 1], ordered[pair], length[pair]
    k = 0
    while len(pair):
        same = t[a + k] == t[b + k]
        pair, a, b, left = pair[same], a[same], b[same], left[same]
        done = left == k
        fresh[pair[done]] = False
        pair, a, b, left = pair[~done], a[~done], b[~done], left[~done]
        k += 1
    return np.cumsum(fresh) - 1


def _sorted(t: np.ndarray) -> np.ndarray:
    """Suffix array of t, whose last symbol is its only 0."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1]
    sizes = np.bincount(t)
    is_s = _s_types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    rough = _induced(t, is_s, lms, sizes)
    leftmost = np.zeros(n, bool)
    leftmost[lms] = True
    ordered = rough[leftmost[rough]]
    nexts = np.zeros(n, np.int64)
    nexts[lms[:-1]] = np.diff(lms)
    names_in_order = _named(t, ordered, nexts)
    if names_in_order[-1] < len(lms) - 1:
        name = np.zeros(n, np.int64)
        name[ordered] = names_in_order
        reduced = name[lms]
        ordered = lms[_sorted(reduced) if names_in_order[-1] < NARROW else _doubled(reduced)]
    return _induced(t, is_s, ordered, sizes)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of a byte string, in byte order."""
    if not len(text):
        return np.zeros(0, np.int64)
    t = np.zeros(len(text) + 1, np.int16)
    t[:-1] = text
    t[:-1] += 1
    return _sorted(t)[1:]


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each position, the length (up to cap) of the prefix that its suffix shares with the one before it in order."""
    n = len(text)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    i = np.flatnonzero(before >= 0)
    j = before[i]
    k = 0
    while len(i) and k < cap:
        differ = words[np.minimum(i + k, n)] ^ words[np.minimum(j + k, n)]
        low = differ & (~differ + np.uint64(1))
        bits = np.where(differ == 0, 64, np.bitwise_count(low - np.uint64(1)))
        got = np.minimum(np.minimum(k + bits // 8, cap), n - np.maximum(i, j))
        out[i] = got
        go = (differ == 0) & (got == k + 8) & (got < cap)
        i, j = i[go], j[go]
        k += 8
    return out
