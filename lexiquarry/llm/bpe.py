"""BPE encoding and decoding with a frequent-word transducer.

A tokenizer file with end-of-word BPE (``word_bpe_49k.json``) is applied exactly as the
tokenizers library applies it: special tokens are cut out of the raw text, the rest is composed (NFC) and
lower-cased, split into words, spelled in byte symbols and merged by rank. Classes and lower case of characters are
the library's own (``pieces``); words with a character that may compose with another go through its normalizer. The words that are
frequent over all documents are merged once, on the driver, and compiled into a minimal acyclic
transducer with id outputs, which every Python worker maps into memory; other words are
merged exactly when they are met. Decoding joins the symbols of the ids with spaces, as the library does
without a decoder.

Defined cases: null and blank texts have no ids and decode to the empty text; texts are taken whole,
however long; equal rows give equal results; an empty table gives an empty result; columns besides those named are not
looked at (``with_ids`` keeps them; its own replace those of the same names).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeping, mapped, steps, stored, table, text_buffers
from .lexicon import Builder, Lexicon
from .pieces import DROPPING, SPACE, Lists, Memory, byte_ends, byte_symbols, code_points, kinds, starts

#: Words in the transducer at most; those of the greatest counts, by powers of two.
LISTED = 1 << 16
#: Words that a task counts before it hands the counts on, and words that a worker remembers.
COUNTED = 1 << 18
REMEMBERED = 1 << 18


_NEVER = 1 << 30


#: Code points from here on are left to the normalizer: few had letters in Unicode 3.2.
LATER = 0x30000


def letters(normalizer) -> tuple[np.ndarray, np.ndarray]:
    """For every code point what the normalizer makes of it, and whether that holds in any text: it does for those that
    never compose with the one before. Only code points of Unicode 3.2 are asked for, whose composition is the same in all later versions."""
    old = unicodedata.ucd_3_2_0
    second = {int(x[1], 16) for c in range(LATER) if (x := old.decomposition(chr(c)).split()) and len(x) == 2 and x[0][0] != "<"}
    # The Hangul vowels and final consonants, which compose by rule.
    second.update(range(0x1160, 0x1200))
    codes = [c for c in range(1, LATER) if not 0xD800 <= c <= 0xDFFF and old.category(chr(c)) != "Cn" and not old.combining(chr(c)) and c not in second]
    made = normalizer.normalize_str("\0".join(map(chr, codes))).split("\0")
    lower, plain = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c, m in zip(codes, made, strict=True):
        if len(m) == 1:
            lower[c], plain[c] = ord(m), True
    plain[0] = True
    return lower, plain


def tables(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, lower case and plainness of all code points under a tokenizer file."""
    from tokenizers import Tokenizer

    spec = json.loads(data)
    split, *more = spec["pre_tokenizer"]["pretokenizers"]
    fits = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and split["pattern"].get("Regex") == DROPPING and split["behavior"] == "Removed" and split["invert"]
    if not fits or any(t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("a tokenizer file with this normalizer or pre-tokenizer is not supported")
    library = Tokenizer.from_str(data.decode("utf-8"))
    return kinds(library.pre_tokenizer), *letters(library.normalizer)


class WordBpe:
    """The merges of one tokenizer file."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"]
        self.specials = {t["content"].encode("utf-8"): t["id"] for t in spec["added_tokens"]}
        self.names: dict[int, bytes] = {i: s.encode("utf-8") for s, i in vocab.items()} | {i: s for s, i in self.specials.items()}
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.suffix] for s in symbols]
        # A pair of ids, as one number, to its rank; and the id that the merge of each rank makes.
        self.merges: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(vocab[a] << 17 | vocab[b], rank)
            self.made.append(vocab[a + b])
        if max(vocab.values()) >> 17:
            raise ValueError("vocabularies of up to 131,072 ids are supported")

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one piece, by merging; a special token is marked by a leading 0xFF, which no text holds."""
        if raw[0] == 0xFF:
            return (self.specials[raw[1:]],)
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        if len(ids) > 48:
            return self._merge_long(ids)
        get, made = self.merges.get, self.made
        ranks = [get(a << 17 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 17 | new, _NEVER)
            if i < len(ranks):
                ranks[i] = get(new << 17 | ids[i + 1], _NEVER)
        return tuple(ids)

    def merge_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """``merge`` of many pieces: in each round every word makes its one next merge, all at once."""
        out: list[tuple[int, ...]] = [()] * len(words)
        raw: list[bytes] = []
        which: list[int] = []
        for i, w in enumerate(words):
            if w[0] == 0xFF or len(w) > 48:
                out[i] = self.merge(w)
            else:
                raw.append(w)
                which.append(i)
        if not raw:
            return out
        if not hasattr(self, "_sorted"):
            keys = np.fromiter(self.merges.keys(), np.int64, len(self.merges))
            order = np.argsort(keys)
            self._sorted = keys[order], np.fromiter(self.merges.values(), np.int64, len(self.merges))[order]
            self._tables = np.array(self.inner, np.int64), np.array(self.final, np.int64), np.array(self.made, np.int64)
        keys, ranks = self._sorted
        inner, final, made = self._tables

        def rank_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a << 17 | b
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, ranks[at], _NEVER)

        size = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = inner[flat]
        last = np.cumsum(size) - 1
        ids[last] = final[flat[last]]
        word = np.repeat(np.arange(len(raw)), size)
        rank = np.full(len(ids), _NEVER, np.int64)
        rank[:-1] = rank_of(ids[:-1], ids[1:])
        rank[last] = _NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(start, len(ids)))
            best = np.minimum.reduceat(rank, start)
            over = np.repeat(best == _NEVER, count)
            if over.any():
                done.append((word[over], ids[over]))
                ids, word, rank = ids[~over], word[~over], rank[~over]
                best, count = best[best != _NEVER], count[best != _NEVER]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == np.repeat(best, count))
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            ids[at] = made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))
            ids, word, rank = ids[keep], word[keep], rank[keep]
            before = moved[(moved > 0) & (word[moved - 1] == word[moved])]
            rank[before - 1] = rank_of(ids[before - 1], ids[before])
            nexts = np.minimum(moved + 1, len(ids) - 1)
            inside = (nexts > moved) & (word[nexts] == word[moved])
            rank[moved] = np.where(inside, rank_of(ids[moved], ids[nexts]), _NEVER)
        word = np.concatenate([w for w, _ in done])
        order = np.argsort(word, kind="stable")
        flat_ids = np.concatenate([i for _, i in done])[order].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(raw))).tolist()
        begin = 0
        for i, end in zip(which, ends):
            out[i] = tuple(flat_ids[begin:end])
            begin = end
        return out

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same merges in the same order, from a heap."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := get(ids[i] << 17 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (rank := get(ids[x] << 17 | ids[y])) is not None:
                    heapq.heappush(heap, (rank, x, ids[x], ids[y]))
        return tuple(i for i in ids if i >= 0)


class Words(Memory):
    """The pieces of texts under one tokenizer file, as numbers."""

    def __init__(self, specials, kind: np.ndarray, lower: np.ndarray, plain: np.ndarray, most: int) -> None:
        from tokenizers import normalizers

        self.special = re.compile(b"|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.kind, self.lower, self.plain = kind, lower, plain
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        super().__init__(most)

    def reset(self) -> None:
        super().reset()
        self.normal: dict[bytes, np.ndarray] = {}

    def pieces(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces of texts that lie one after another, and where those of each text end (with a
        leading 0). Special tokens are pieces too, with a leading 0xFF."""
        data = flat.tobytes()
        if self.special is None or self.special.search(data) is None:
            return self._plain(flat, offsets)
        parts: list[bytes] = []
        marks: list[bytes] = []
        at, rows = [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text, done = data[a:b], 0
            for m in self.special.finditer(text):
                parts.append(text[done : m.start()])
                at.append(len(parts))
                marks.append(b"\xff" + m[0])
                done = m.end()
            parts.append(text[done:])
            rows.append(len(parts))
        size = np.array([len(m) for m in marks] + [len(p) for p in parts], np.int64)
        joined = np.frombuffer(b"".join(parts), np.uint8)
        numbers, ends = self._plain(joined, np.concatenate(([0], np.cumsum(size[len(marks) :]))))
        known = self.count
        own = self.numbers(np.frombuffer(b"".join(marks), np.uint8), np.cumsum(size[: len(marks)]) - size[: len(marks)], size[: len(marks)])
        if self.count < known:
            # The memory began anew with the marks; the pieces are met again.
            numbers, ends = self._plain(joined, np.concatenate(([0], np.cumsum(size[len(marks) :]))))
            own = self.numbers(np.frombuffer(b"".join(marks), np.uint8), np.cumsum(size[: len(marks)]) - size[: len(marks)], size[: len(marks)])
        where = np.array(at, np.int64)
        numbers = np.insert(numbers, ends[where], own)
        return numbers, ends[rows] + np.searchsorted(where, rows, side="right")

    def _plain(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(flat):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        if flat.max() < 128:
            code, rows = self.lower[:128].take(flat), offsets
        else:
            raw = code_points(flat.tobytes())
            rows = np.searchsorted(byte_ends(raw), offsets)
            code = self.lower.take(raw)
            hard = np.flatnonzero(~self.plain.take(raw))
            if len(hard):
                code, rows = self._normalised(raw, code, rows, hard)
        kind = self.kind.take(code)
        begin = np.flatnonzero(starts(code, kind, rows[:-1][np.diff(rows) > 0], False))
        size = np.diff(begin, append=len(code))
        solid = kind[begin] != SPACE
        begin, size = begin[solid], size[solid]
        row_ends = np.searchsorted(begin, rows)
        if code.max() < 128:
            text = code.astype(np.uint8)
        else:
            text = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
            ends = byte_ends(code)
            begin, size = ends[begin], ends[begin + size] - ends[begin]
        return self.numbers(text, begin, size), row_ends

    def _normalised(self, raw: np.ndarray, code: np.ndarray, rows: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts with every word between white space that has a hard character as the normalizer makes it."""
        solid = self.kind.take(raw) != SPACE
        edge = np.zeros(len(raw) + 1, bool)
        edge[rows] = True
        opens, closes = solid.copy(), solid.copy()
        opens[1:] &= ~solid[:-1] | edge[1:-1]
        closes[:-1] &= ~solid[1:] | edge[1:-1]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        which = np.unique(np.searchsorted(begin, hard, side="right") - 1)
        begin, end = begin[which], end[which]
        out, done, more = [], 0, np.zeros(len(which) + 1, np.int64)
        for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
            word = raw[a:b].tobytes()
            made = self.normal.get(word)
            if made is None:
                if len(self.normal) >= self.most:
                    self.normal.clear()
                made = self.normal[word] = np.frombuffer(self.normalizer.normalize_str(word.decode("utf-32-le")).encode("utf-32-le"), np.uint32)
            out += [code[done:a], made]
            done, more[k + 1] = b, len(made) - (b - a)
        out.append(code[done:])
        return np.concatenate(out), rows + np.cumsum(more)[np.searchsorted(end, rows, side="right")]


class Encoder(Words):
    """A tokenizer with its transducer and the pieces it met lately."""

    def __init__(self, bpe: WordBpe, about: tuple, lexicon: Lexicon) -> None:
        self.bpe, self.lexicon = bpe, lexicon
        super().__init__(bpe.specials, *about, REMEMBERED)

    def reset(self) -> None:
        super().reset()
        self.ids, self.decoded = Lists(np.uint32), []

    def learn(self, words: list[bytes]) -> None:
        found = self.lexicon.look_up(words)
        unseen = iter(self.bpe.merge_many([w for w, x in zip(words, found) if x is None]))
        new = [x if x is not None else next(unseen) for x in found]
        self.ids.add(new)
        name = self.bpe.names.__getitem__
        self.decoded += [b" ".join(map(name, x)) for x in new]

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
        """For each text, its ids and the places of its words in ``decoded``."""
        numbers, rows = self.pieces(flat, offsets)
        ids, ends = self.ids.joined(numbers)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            yield ids[ends[a] : ends[b]], numbers[a:b].tolist()


_LOADED: dict[bytes, Encoder] = {}


def _loaded(data: bytes, about: tuple, lexicon: bytes) -> Encoder:
    """The tokenizer in this worker, built once."""
    key = hashlib.sha256(data + b"|" + lexicon).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(WordBpe(data), about, Lexicon(lexicon))
    return _LOADED[key]


class Counter(Words):
    """Pieces with their counts."""

    def reset(self) -> None:
        super().reset()
        self.words: list[bytes] = []
        self.n = np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        self.words += words
        self.n = np.concatenate((self.n, np.zeros(len(words), np.int64)))


def _counts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of the pieces of a task that occur twice or more before it hands them on."""
        counts = Counter(*shared.value, 1 << 62)

        def handed() -> pa.RecordBatch:
            often = [k for k in np.flatnonzero(counts.n > 1).tolist() if counts.words[k][0] != 0xFF]
            return pa.record_batch({"word": pa.array([counts.words[k] for k in often], pa.binary()), "n": pa.array(counts.n[often])})

        for batch in batches:
            flat, offsets = text_buffers(batch["text"])
            for i, j in steps(offsets):
                numbers, _ = counts.pieces(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                counts.n += np.bincount(numbers, minlength=len(counts.n))
                if counts.count > COUNTED:
                    yield handed()
                    counts.reset()
        yield handed()

    return run


def frequent_words(docs: DataFrame, shared, most: int = LISTED) -> list[bytes]:
    """Words of the greatest counts over all documents, at most ``most`` of them. shared: a broadcast of the special tokens and ``tables``."""
    counts = stored(mapped(docs.select("text"), _counts(shared), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n")).cast("int")
    least, room = 64, most
    for step, many in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= many
        if room < 0:
            break
        least = step
    return counts.filter(level >= least).select("word").toArrow()["word"].to_pylist()


def compiled(bpe: WordBpe, words: list[bytes]) -> bytes:
    builder = Builder()
    for w in sorted(set(words)):
        if len(w) <= 64:
            builder.add(w, bpe.merge(w))
    return builder.finish()


_OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def _encoded(shared, about, lexicon, outputs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(shared.value, about.value[1:], lexicon.value)
        try:
            for batch in batches:
                yield from coded(encoder, batch)
        finally:
            # The worker lives on for other work; what it remembers of this text would stay with it.
            encoder.reset()

    def coded(encoder: Encoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
        flat, offsets = text_buffers(batch["text"])
        wanted = any(o.startswith("decoded") for o in outputs)
        for i, j in steps(offsets):
            got: dict[str, list] = {o: [] for o in outputs}
            for ids, at in encoder.encode(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                decoded = b" ".join(map(encoder.decoded.__getitem__, at)) if wanted else b""
                make = {
                    "n_tokens": lambda: len(ids),
                    "ids": lambda: ids.astype(np.int32),
                    "decoded": lambda: decoded.decode("utf-8"),
                    "ids_sha256": lambda: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                    "decoded_sha256": lambda: hashlib.sha256(decoded).hexdigest(),
                }
                for o in outputs:
                    got[o].append(make[o]())
            yield pa.record_batch([batch["kept"].slice(i, j - i), *(pa.array(v, types.get(o, pa.string())) for o, v in got.items())], ["kept", *outputs])

    return run


def encoded(docs: DataFrame, path: str, keep: list[str], outputs: list[str], listed: int = LISTED) -> DataFrame:
    """The columns ``keep`` and the outputs (of n_tokens, ids, decoded, ids_sha256 and decoded_sha256) of every text."""
    context = docs.sparkSession.sparkContext
    with open(path, "rb") as f:
        data = f.read()
    bpe = WordBpe(data)
    shared, about = context.broadcast(data), context.broadcast((list(bpe.specials), *tables(data)))
    lexicon = context.broadcast(compiled(bpe, frequent_words(docs, about, listed)))
    keep = [c for c in keep if c not in outputs]
    made = ", ".join(f"{o} {_OUTPUTS[o]}" for o in outputs)
    return keeping(docs, keep, {"text": F.col("text")}, _encoded(shared, about, lexicon, outputs), made)


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """All columns of the documents, and ids and n_tokens of their texts."""
    return encoded(docs, path, docs.columns, ["ids", "n_tokens"])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(), ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"])
