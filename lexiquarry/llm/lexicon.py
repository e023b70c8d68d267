"""A minimal acyclic transducer: words to sequences of token ids, with shared suffixes.

Built word by word in byte order (the incremental construction of Daciuk et al.): once a later word
leaves a branch, its states are final and equal ones become one. Outputs are sequences of
ids and sit on the edges, pushed as far to the front as words agree on them, so that suffixes
with equal remainders still share states. The states are laid out as flat
arrays in one buffer, which readers map into memory."""

from __future__ import annotations

import mmap
import os
import tempfile

import numpy as np

_MAGIC = 0x4C58464F


class Builder:
    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []
        # The path of the last word: each entry is [edges {byte: [target, output]}, final, final output].
        self.path: list[list] = [[{}, False, ()]]
        self.last = b""

    def add(self, word: bytes, ids: tuple[int, ...]) -> None:
        if self.last and word <= self.last:
            raise ValueError("words must come in byte order, each once")
        common = 0
        while common < min(len(word), len(self.last)) and word[common] == self.last[common]:
            common += 1
        self._freeze(common)
        # Keep on the shared path only what both agree on; push the rest of the old outputs down.
        out = ids
        for i in range(common):
            edge = self.path[i][0][word[i]]
            shared = 0
            while shared < min(len(out), len(edge[1])) and out[shared] == edge[1][shared]:
                shared += 1
            rest, edge[1] = edge[1][shared:], edge[1][:shared]
            if rest:
                node = self.path[i + 1]
                for e in node[0].values():
                    e[1] = rest + e[1]
                if node[1]:
                    node[2] = rest + node[2]
            out = out[shared:]
        for b in word[common:]:
            self.path[-1][0][b] = [-1, ()]
            self.path.append([{}, False, ()])
        if common < len(word):
            self.path[common][0][word[common]][1] = out
            self.path[-1][1] = True
        else:
            self.path[-1][1], self.path[-1][2] = True, out
        self.last = word

    def _freeze(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            edges, final, output = self.path.pop()
            state = (tuple((b, t, o) for b, (t, o) in sorted(edges.items())), final, output)
            known = self.register.get(state)
            if known is None:
                known = self.register[state] = len(self.states)
                self.states.append(state)
            self.path[-1][0][self.last[len(self.path) - 1]][0] = known

    def finish(self) -> bytes:
        self._freeze(0)
        edges, final, output = self.path[0]
        self.states.append((tuple((b, t, o) for b, (t, o) in sorted(edges.items())), final, output))
        pool: dict[tuple, int] = {(): 0}
        flat: list[int] = []
        starts = [0]

        def place(ids: tuple) -> int:
            if ids not in pool:
                pool[ids] = len(pool)
                flat.extend(ids)
                starts.append(len(flat))
            return pool[ids]

        starts.append(0)
        first, byte, target, out, ends = [0], [], [], [], []
        for edges_, is_final, final_out in self.states:
            for b, t, o in edges_:
                byte.append(b), target.append(t), out.append(place(o))
            first.append(len(byte))
            ends.append(place(final_out) if is_final else -1)
        parts = [np.array(x, np.int32) for x in (first, byte, target, out, ends, starts, flat)]
        head = np.array([_MAGIC, *[len(x) for x in parts]], np.int32)
        return b"".join(x.tobytes() for x in (head, *parts))


class Lexicon:
    """Looks words up, many at a time."""

    def __init__(self, data: bytes) -> None:
        self.map = self._mapped(data)
        ints = np.frombuffer(self.map, np.int32)
        if ints[0] != _MAGIC:
            raise ValueError("not a lexicon")
        at, parts = 8, []
        for n in ints[1:8]:
            parts.append(ints[at : at + n])
            at += int(n)
        self.first, self.byte, self.target, self.out, self.ends, self.starts, self.flat = parts
        self.root = len(self.first) - 2
        # (state, byte) in one sorted key per edge: edges of a state are sorted, and states are numbered in order.
        self.keys = np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), np.diff(self.first)) * 256 + self.byte
        self.outputs = [tuple(self.flat[a:b].tolist()) for a, b in zip(self.starts[:-1], self.starts[1:])]

    @staticmethod
    def _mapped(data: bytes) -> mmap.mmap:
        """The bytes as a private file mapped for reading; the file's name goes at once."""
        handle, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
            with open(path, "rb") as f:
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        finally:
            os.unlink(path)

    def look_up(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """Ids of each word, None if it isn't listed; all words take a step at a time."""
        n = len(words)
        if not n or not len(self.keys):
            return [None] * n
        length = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        state = np.full(n, self.root, np.int64)
        trail = np.zeros((n, min(64, int(length.max(initial=0)))), np.int32)
        alive = np.flatnonzero((length > 0) & (length <= 64))
        found: list = [None] * n
        step = 0
        while len(alive):
            key = state[alive] * 256 + text[begin[alive] + step]
            e = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[e] == key
            alive, e = alive[hit], e[hit]
            state[alive] = self.target[e]
            trail[alive, step] = self.out[e]
            step += 1
            done = length[alive] == step
            for i in alive[done]:
                end = self.ends[state[i]]
                if end >= 0:
                    ids: tuple = ()
                    for o in trail[i, :step]:
                        if o:
                            ids += self.outputs[o]
                    found[i] = ids + self.outputs[end]
            alive = alive[~done]
        return found
