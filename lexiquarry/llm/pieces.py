"""Texts cut into the pieces of a BPE tokenizer, many at a time, and a memory of pieces.

Character classes are not taken from any table of Python: the tokenizers library is asked once for every code
point, so pieces agree with it whatever Unicode version either has. Where the runs of classes begin and end follows in
numpy. Both split patterns known here are ``contraction | letters | numbers | others`` in this order; they differ in
whether a space opens the piece behind it (byte-level vocabularies) or all white space goes (end-of-word ones)."""

from __future__ import annotations

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CODES = 0x110000

#: The endings that a quote takes into a piece of its own.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The split patterns that ``starts`` cuts by.
JOINING = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DROPPING = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def scalars() -> np.ndarray:
    """All code points but surrogates."""
    every = np.arange(CODES)
    return every[(every < 0xD800) | (every > 0xDFFF)]


def kinds(pre_tokenizer) -> np.ndarray:
    """The class of every code point, as the library's pre-tokenizer treats it."""

    def cuts(codes: np.ndarray, beside: str) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code point stands in one piece with its neighbours, and whether it is in a piece at all."""
        text = beside + "".join(chr(c) + beside for c in codes)
        edge, inside = np.zeros(len(text) + 1, bool), np.zeros(len(text) + 1, np.int32)
        for _, (i, j) in pre_tokenizer.pre_tokenize_str(text):
            edge[i] = edge[j] = True
            inside[i] += 1
            inside[j] -= 1
        return ~(edge[1:-2:2] | edge[2:-1:2]), np.cumsum(inside)[1:-2:2] > 0

    out = np.full(CODES, OTHER, np.uint8)
    left = scalars()
    left = np.concatenate([c[~cuts(c, "!")[0]] for c in np.array_split(left, 32)])
    for letters in np.array_split(left, 8):
        out[letters] = np.where(cuts(letters, "a")[0], LETTER, SPACE)
    left = left[out[left] == SPACE]
    single = len(pre_tokenizer.pre_tokenize_str("11")) == 2
    out[left[cuts(left, "a")[1] if single else cuts(left, "1")[0]]] = NUMBER
    return out


def _contractions(code: np.ndarray, kind: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
    """Quotes that begin a piece take one of ENDINGS with them; first marks the first character of each row."""
    at = np.flatnonzero((code == 39) & start)
    at = at[at + 1 < len(code)]
    at = at[(kind[at + 1] == LETTER) & ~first[at + 1]]
    if not len(at):
        return
    n = len(code)
    second = code[at + 1]
    third = np.where(at + 2 < n, code[np.minimum(at + 2, n - 1)], 0)
    third = np.where(first[np.minimum(at + 2, n - 1)], 0, third)
    size = np.zeros(len(at), np.int64)
    for e in ENDINGS:
        hit = second == ord(e[0])
        if len(e) == 2:
            hit &= third == ord(e[1])
        size[hit & (size == 0)] = len(e)
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    after = at + 1 + size
    start[after[after < n]] = True


def starts(code: np.ndarray, kind: np.ndarray, rows: np.ndarray, joining: bool) -> np.ndarray:
    """Where pieces begin in texts that lie one after another; rows: where each non-empty text begins."""
    n = len(code)
    first = np.zeros(n, bool)
    first[rows] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first
    if not joining:
        start |= kind == NUMBER
        _contractions(code, kind, start, first)
        return start
    # Of white space before something else, the last character stands alone; a space opens the next piece.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    _contractions(code, kind, start, first)
    return start


_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a string that fit its key, beside its size.
SHORT = 15


class Memory:
    """Numbers byte strings in the order in which they are met. Up to SHORT bytes are, with their number of bytes, the
    key itself, in an open table; longer strings are in a dictionary. Beyond ``most`` strings it forgets all and begins anew."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.reset()

    def learn(self, words: list[bytes]) -> None:
        """Called with the strings that get the next numbers."""

    def reset(self) -> None:
        self.bits = 16
        # Numbers from 1; the keys at 0 are those of nothing.
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.low, self.high = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)
        self.count = 0
        self.long: dict[bytes, int] = {}

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (((low ^ (high * _C2)) * _C1) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _found(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is new."""
        slot = self._slot(low, high)
        out = self.slots.take(slot).astype(np.int64)
        wrong = (self.low.take(out) != low) | (self.high.take(out) != high)
        left = np.flatnonzero(wrong)
        on = out[left] > 0
        out[left] = 0
        left, slot = left[on], slot[left[on]]
        while len(left):
            slot = (slot + 1) & (len(self.slots) - 1)
            here = self.slots[slot].astype(np.int64)
            same = (self.low[here] == low[left]) & (self.high[here] == high[left])
            out[left[same]] = here[same]
            on = ~same & (here > 0)
            left, slot = left[on], slot[on]
        return out - 1

    def _place(self, number: np.ndarray) -> None:
        slot, number = self._slot(self.low[number], self.high[number]), number.astype(np.int32)
        while len(slot):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = number[free]
            left = self.slots[slot] != number
            slot, number = (slot[left] + 1) & (len(self.slots) - 1), number[left]

    def _grown(self, low: np.ndarray, high: np.ndarray, short: list[bytes], far: list[bytes]) -> None:
        """Distinct new strings: short ones by their keys, and long ones."""
        old, need = self.count + 1, self.count + 1 + len(short) + len(far)
        if need > len(self.low):
            more = np.zeros(max(need, 2 * len(self.low)) - len(self.low), np.uint64)
            self.low, self.high = np.concatenate((self.low, more)), np.concatenate((self.high, more))
        self.low[old : old + len(short)], self.high[old : old + len(short)] = low, high
        if 2 * need > len(self.slots):
            self.bits = (4 * need).bit_length()
            self.slots = np.zeros(1 << self.bits, np.int32)
            # Keys of long strings stay empty.
            self._place(np.flatnonzero(self.high[: old + len(short)]))
        else:
            self._place(np.arange(old, old + len(short)))
        self.long.update(zip(far, range(old + len(short) - 1, need - 1)))
        self.count = need - 1
        self.learn(short + far)

    def numbers(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each string flat[begin : begin + size]; new ones are learned."""
        padded = np.concatenate((flat, np.zeros(16, np.uint8)))
        words = np.ndarray((len(flat) + 9,), "<u8", padded, strides=(1,))
        low = words[begin] & _MASKS.take(np.minimum(size, 8))
        high = size.astype(np.uint64) << np.uint64(56)
        at = np.flatnonzero(size > 8)
        high[at] |= words[begin[at] + 8] & _MASKS.take(np.minimum(size[at], SHORT) - 8)
        far_at = at[size[at] > SHORT]
        out = self._found(low, high)
        far = [flat[b : b + s].tobytes() for b, s in zip(begin[far_at].tolist(), size[far_at].tolist())]
        out[far_at] = 0
        new = np.flatnonzero(out < 0)
        unknown = [w for w in dict.fromkeys(far) if w not in self.long]
        if len(new) or unknown:
            a, b = low[new], high[new]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            if self.count and self.count + int(fresh.sum()) + len(unknown) > self.most:
                self.reset()
                return self.numbers(flat, begin, size)
            which = new[order[fresh]]
            self._grown(a[fresh], b[fresh], [flat[x : x + n].tobytes() for x, n in zip(begin[which].tolist(), size[which].tolist())], unknown)
            out[new] = self._found(low[new], high[new])
        if far:
            out[far_at] = [self.long[w] for w in far]
        return out


class Lists:
    """One list of values for each number, and the lists of many numbers one after another."""

    def __init__(self, dtype) -> None:
        self.flat, self.start, self.size = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, lists: list) -> None:
        self.extend(np.array([i for x in lists for i in x], self.flat.dtype), np.array([len(x) for x in lists], np.int64))

    def extend(self, flat: np.ndarray, size: np.ndarray) -> None:
        """More lists, one after another, of these sizes."""
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, flat))

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values in order, and where those of each number end (with a leading 0)."""
        size = self.size[numbers]
        ends = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        where = np.arange(ends[-1]) + np.repeat(self.start[numbers] - ends[:-1], size)
        return self.flat[where], ends


def code_points(text: bytes) -> np.ndarray:
    """The code points of UTF-8 bytes."""
    return np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)


def byte_ends(code: np.ndarray) -> np.ndarray:
    """The UTF-8 byte offset of every code point (n + 1)."""
    out = np.zeros(len(code) + 1, np.int64)
    np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), out=out[1:])
    return out
