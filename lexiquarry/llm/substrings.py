"""Exact removal of repeated substrings by suffix arrays of shards.

Texts are UTF-8 bytes. A byte goes when a 100-byte string that covers it also starts earlier:
in a smaller doc_id, or earlier in the same document. Matches stay inside documents, and
strings are judged on the input.

Equal strings have the same least 32-byte hash, so that hash deals them to a shard: every
maximal run of string starts with one least hash is a "context", and equal
strings are only ever in contexts of one hash.

1. Contexts are dealt by their hash, packed by batch, as hash, content hash and place (28 bytes
   for about 36 bytes of text). Of equal contexts (64-bit content hash within one least hash) all but the first go.
   Where one least hash has several different contexts, the first of each is asked for, as is a context
   that may repeat itself (its least hash occurs twice close together).
2. The bytes of those alone are dealt by least hash. Each shard builds a suffix array by
   induced sorting, and permuted common prefixes; suffixes in a row that share 100 bytes
   are one string, and all its places but the first go.

A least hash counted more often than ``FREQUENT`` times the number of documents (and ``MANY`` times) would gather in one
shard. Its strings are dealt singly instead, by 128-bit hashes, after each batch has kept its own first of each.
There are at most (mean contexts of a document) / FREQUENT such hashes. Occurrences count where a task holds three or more at once, so
all of a hash that is in over one of a thousand documents, but few of one in a tenth of that; counting says only which way a
hash goes, the result is the same.

Defined cases: null texts are empty; texts under 100 bytes lose nothing unless covered, which they cannot be;
rows that share a doc_id (or have none) are told apart by a number given in order of doc_id (nulls first) and
text, so that the earlier one keeps its bytes; empty tables give an empty result; other columns are kept by
``without_repeats`` (its own columns replace those of the same names) and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import longs, mapped, mixed, partitions, steps, stored, table, text_buffers
from .shingles import block_hashes, powers
from .suffixes import permuted_prefixes, suffix_array

LENGTH = 100
GRAM = 32
FREQUENT = 1e-4
MANY = 5000
#: Contexts or strings that a task holds before it deals them, and bytes of a shard's suffix array.
HELD = 1 << 19
SHARD_BYTES = 1 << 20

_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sums(flat: np.ndarray, power: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[: len(flat)], out=out[1:])
    return out


def contexts(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(least hash, row, first start, number of starts, content hash) of every context of a
    step of rows, and the prefix sums that its hashes come from. The number is negative where
    the context itself may hold a string twice."""
    n, width = len(flat), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none, none, none, none.view(np.uint64), None
    p, inv = powers(n + 1)
    sums = _sums(flat, p)
    h = mixed((sums[gram:] - sums[:-gram]) * inv[: n - gram + 1])
    padded = np.concatenate((h, np.full(-len(h) % width, _TOP))).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
    first, last = offsets[:-1], offsets[1:] - (length - 1)
    long_enough = last > first
    level = np.zeros(n + 2, np.int32)
    np.add.at(level, first[long_enough], 1)
    np.add.at(level, last[long_enough], -1)
    valid = np.cumsum(level)[:starts] > 0
    turn = np.ones(starts + 1, bool)
    np.not_equal(least[1:], least[:-1], out=turn[1:-1])
    turn[first[long_enough]] = True
    turn[last[long_enough]] = True
    turns = np.flatnonzero(turn)
    begin, end = turns[:-1], turns[1:]
    keep = valid[begin]
    begin, end = begin[keep], end[keep]
    content = block_hashes(flat, begin, end - begin + length - 1)
    row = np.searchsorted(offsets, begin, side="right") - 1
    value, many = least[begin], end - begin
    # A context can hold equal strings itself only if its least hash occurs twice close together.
    gate = np.zeros(1 << 20, bool)
    gate[(value >> np.uint64(44)).astype(np.int64)] = True
    at = np.flatnonzero(gate[(h >> np.uint64(44)).astype(np.int64)])
    at = at[np.argsort(h[at], kind="stable")]
    close = (h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] < 2 * width)
    if close.any():
        many = np.where(np.isin(value, h[at[1:][close]]), -many, many)
    return value, row, begin - offsets[row], many, content, sums


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least hashes that occur three times or more among the contexts a task holds at once."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch({"h": pa.array(h[n > 2].view(np.int64)), "n": pa.array(n[n > 2])})

    held: list[np.ndarray] = []
    for batch in batches:
        flat, offsets = text_buffers(batch["text"])
        for i, j in steps(offsets):
            held.append(contexts(flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0])
        if sum(map(len, held)) >= HELD:
            yield often(held)
            held = []
    if held:
        yield often(held)


def _string_hashes(flat: np.ndarray, starts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for the strings at these starts."""
    p, inv = powers(len(flat) + 1)
    a = mixed((sums[starts + LENGTH] - sums[starts]) * inv[starts])
    # Powers of the squared base, and its inverse, are every other power of the first.
    p2, inv2 = p * p, inv * inv
    more = _sums(flat, p2)
    return a, mixed((more[starts + LENGTH] - more[starts]) * inv2[starts] + np.uint64(7))


_PACKED = "part int, kind int, k1 binary, k2 binary, doc binary, at binary, n binary"


def _dealt(frequent, parts: int):
    """Packed rows by shard. Kind 0: contexts (least hash, content hash, place, starts). Kind 1:
    strings of frequent hashes (two hashes, place). Kind 2: places already known to go."""

    def packed(kind: int, k1, k2, doc, at, n, to) -> Iterator[pa.RecordBatch]:
        part = (to % np.uint64(parts)).astype(np.int32)
        # Beside its shard, 32 bits of a least hash are enough: two that share them only cause a comparison.
        k1 = ((k1 // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) if kind == 0 else k1
        order = np.argsort(part, kind="stable")
        part, k1, k2, doc, at, n = part[order], k1[order], k2[order], doc[order], at[order], n[order]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        for i, j in zip(cuts[:-1], cuts[1:]):
            yield pa.record_batch({"part": pa.array([int(part[i])], pa.int32()), "kind": pa.array([kind], pa.int32())} | {c: pa.array([x[i:j].tobytes()], pa.binary()) for c, x in (("k1", k1), ("k2", k2), ("doc", doc), ("at", at), ("n", n))})

    def flushed(held: list, strings: list) -> Iterator[pa.RecordBatch]:
        if held:
            h, c, doc, at, n = (np.concatenate(x) for x in zip(*held))
            if len(h):
                yield from packed(0, h, c, doc, at, n, h)
        if strings:
            a, b, doc, at = (np.concatenate(x) for x in zip(*strings))
            order = np.lexsort((at, doc, b, a))
            a, b, doc, at = a[order], b[order], doc[order], at[order]
            fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            n = np.full(len(a), 1, np.int32)
            yield from packed(1, a[fresh], b[fresh], doc[fresh], at[fresh], n[fresh], a[fresh])
            if not fresh.all():
                doc, at, n = merged(doc[~fresh], at[~fresh], n[~fresh])
                zero = np.zeros(len(doc), np.uint64)
                yield from packed(2, zero, zero, doc, at, n, mixed(doc.view(np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        held, strings, count = [], [], 0
        for batch in batches:
            ids = longs(batch["doc_id"])
            flat, offsets = text_buffers(batch["text"])
            for i, j in steps(offsets):
                own, inner = flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, row, at, n, content, sums = contexts(own, inner)
                if not len(h):
                    continue
                if len(late):
                    where = np.minimum(np.searchsorted(late, h), len(late) - 1)
                    hot = late[where] == h
                    if hot.any():
                        rows, first, many = row[hot], at[hot], np.abs(n[hot])
                        each = np.repeat(np.arange(len(rows)), many)
                        start = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + first[each]
                        a, b = _string_hashes(own, inner[rows[each]] + start, sums)
                        strings.append((a, b, ids[i + rows[each]], start.astype(np.int32)))
                        count += len(a)
                        h, row, at, n, content = h[~hot], row[~hot], at[~hot], n[~hot], content[~hot]
                held.append((h, content, ids[i + row], at.astype(np.int32), n.astype(np.int32)))
                count += len(h)
                if count >= HELD:
                    yield from flushed(held, strings)
                    held, strings, count = [], [], 0
        yield from flushed(held, strings)

    return run


def merged(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts (doc, at, n), with those that touch or overlap as one."""
    if not len(doc):
        return doc, at, n
    order = np.lexsort((at, doc))
    doc, at, n = doc[order], at[order].astype(np.int64), n[order].astype(np.int64)
    # Documents one after another on a line, each as long as its last run reaches.
    turn = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    room = np.maximum.reduceat(at + n, turn) + 1
    line = np.repeat(np.cumsum(room) - room, np.diff(np.append(turn, len(doc))))
    reach = np.maximum.accumulate(line + at + n)
    fresh = np.concatenate(([True], line[1:] + at[1:] > reach[:-1]))
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], at[first].astype(np.int32), (reach[last] - line[first] - at[first]).astype(np.int32)


_PLACES = "part int, key long, doc_id long, at int, n int"


def _places(part, key, doc, at, n) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(doc), 1 << 16):
        s = slice(i, i + (1 << 16))
        yield pa.record_batch({"part": pa.array(part[s], pa.int32()), "key": pa.array(key[s]), "doc_id": pa.array(doc[s]), "at": pa.array(at[s], pa.int32()), "n": pa.array(n[s], pa.int32())})


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of starts that go (part -1), and the contexts to compare byte by byte (by part)."""
    got: dict[int, list] = {0: [], 1: [], 2: []}
    for batch in batches:
        for part, kind, k1, *x in zip(*(batch[c].to_pylist() for c in ("part", "kind", "k1", "k2", "doc", "at", "n"))):
            key = np.frombuffer(k1, np.uint32).astype(np.uint64) | np.uint64(part << 32) if kind == 0 else np.frombuffer(k1, np.uint64)
            got[kind].append((key, *(np.frombuffer(b, t) for b, t in zip(x, (np.uint64, np.int64, np.int32, np.int32)))))
    gone = [x[2:] for x in got.pop(2)]
    for kind in (0, 1):
        if not got[kind]:
            continue
        k1, k2, doc, at, n = (np.concatenate(x) for x in zip(*got.pop(kind)))
        order = np.lexsort((k2, k1))
        k1, k2, doc, at, n = k1[order], k2[order], doc[order], at[order], n[order]
        new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        # Only what shares both hashes has to be put in order of place.
        many = ~(new & np.append(new[1:], True))
        sub = np.flatnonzero(many)
        o = sub[np.lexsort((at[sub], doc[sub], k2[sub], k1[sub]))]
        doc[sub], at[sub], n[sub] = doc[o], at[o], n[o]
        gone.append((doc[~new], at[~new], np.abs(n[~new])))
        if kind == 0:
            k1, doc, at, n = k1[new], doc[new], at[new], n[new]
            same = k1[1:] == k1[:-1]
            several = np.concatenate(([False], same)) | np.concatenate((same, [False])) | (n < 0)
            k1, doc, at, n = k1[several], doc[several], at[several], np.abs(n[several])
            yield from _places((k1 >> np.uint64(32)).astype(np.int32), k1.view(np.int64), doc, at, n)
    if gone:
        doc, at, n = merged(*(np.concatenate(x) for x in zip(*gone)))
        yield from _places(np.full(len(doc), -1, np.int32), np.zeros(len(doc), np.int64), doc, at, n)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts asked for."""
    for batch in batches:
        flat, offsets = text_buffers(batch["text"])
        doc = longs(batch["doc_id"])
        out: list[tuple] = []
        for r, asked in enumerate(batch["asked"].to_pylist()):
            own = flat[offsets[r] : offsets[r + 1]].tobytes()
            out += [(a["part"], a["key"], doc[r], a["at"], own[a["at"] : a["at"] + a["n"] - 1 + LENGTH]) for a in asked]
        for i in range(0, len(out), 4096):
            part, key, ids, at, body = zip(*out[i : i + 4096])
            yield pa.record_batch({"part": pa.array(part, pa.int32()), "key": pa.array(key, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "at": pa.array(at, pa.int32()), "body": pa.array(body, pa.binary())})


def repeats_in(doc: np.ndarray, at: np.ndarray, bodies: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose string starts earlier in another of these contexts."""
    order = np.lexsort((at, doc))
    sizes = np.array([len(bodies[i]) for i in order], np.int64)
    text = np.frombuffer(b"".join(bodies[i] for i in order), np.uint8)
    begin = np.cumsum(sizes) - sizes
    sa = suffix_array(text)
    shared = permuted_prefixes(text, sa, length)[sa] >= length
    whole = np.zeros(len(text), bool)
    level = np.zeros(len(text) + 1, np.int32)
    np.add.at(level, begin, 1)
    np.add.at(level, begin + sizes - length + 1, -1)
    whole = np.cumsum(level)[: len(text)] > 0
    # Text order is place order, so the least position of a group of equal strings is its first place.
    group = np.cumsum(~shared)
    keep = whole[sa]
    pos, group = sa[keep], group[keep]
    if not len(pos):
        return doc[:0], at[:0], at[:0]
    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    first = np.repeat(np.minimum.reduceat(pos, edge), np.diff(np.append(edge, len(pos))))
    later = np.sort(pos[pos != first])
    c = np.searchsorted(begin, later, side="right") - 1
    own = order[c]
    return merged(doc[own], (at[own] + later - begin[c]).astype(np.int32), np.ones(len(later), np.int32))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = ("key", "doc_id", "at", "body")
    rows = pa.Table.from_batches(list(batches), pa.schema([("part", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("body", pa.binary())]))
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    key, doc, at = (rows[c].to_numpy() for c in columns[:3])
    body = rows["body"]
    order = np.argsort(key, kind="stable")
    size = np.cumsum(pc.binary_length(body).to_numpy().astype(np.int64)[order])
    i = 0
    while i < len(order):
        # Whole keys up to SHARD_BYTES, or one larger key.
        before = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, before + SHARD_BYTES, side="right")))
        if j < len(order):
            k = int(np.searchsorted(key[order], key[order[j]], side="left"))
            j = k if k > i else int(np.searchsorted(key[order], key[order[j]], side="right"))
        own = order[i:j]
        d, a, n = repeats_in(doc[own], at[own], body.take(pa.array(own)).to_pylist())
        yield from _places(np.full(len(d), -1, np.int32), np.zeros(len(d), np.int64), d, a, n)
        i = j


def _kept(as_text: bool):
    """The bytes that stay of each text; as text without the characters that were cut in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = text_buffers(batch["text"])
            n, kept, spans = [], [], []
            lists = batch["gone"]
            ends, values = lists.offsets.to_numpy(), lists.values
            where, many = values.field("at").to_numpy().astype(np.int64), values.field("n").to_numpy().astype(np.int64)
            for r in range(batch.num_rows):
                own = flat[offsets[r] : offsets[r + 1]]
                a, m = where[ends[r] : ends[r + 1]], many[ends[r] : ends[r + 1]] + (LENGTH - 1)
                if len(a):
                    _, a, m = merged(np.zeros(len(a), np.int64), a, m)
                    mask = np.zeros(len(own) + 1, np.int32)
                    np.add.at(mask, np.minimum(a, len(own)), 1)
                    np.add.at(mask, np.minimum(a.astype(np.int64) + m, len(own)), -1)
                    own = own[np.cumsum(mask)[: len(own)] == 0]
                spans.append([{"at": int(x), "n": int(y)} for x, y in zip(a, m)])
                kept.append(own.tobytes().decode("utf-8", "ignore") if as_text else own.tobytes())
                n.append(int(offsets[r + 1] - offsets[r]))
            places = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
            yield pa.record_batch([batch["doc_id"], batch["_row"], pa.array(n, pa.int64()), pa.array(spans, places), pa.array(kept, pa.string() if as_text else pa.binary())], ["doc_id", "_row", "n_bytes", "spans", "kept"])

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with _row, a number in order of doc_id: the doc_id itself where those differ."""
    twice = docs.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull())
    if twice.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    ordered = docs.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "text").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return stored(ordered.withColumn("_row", F.monotonically_increasing_id()))


def repeated(docs: DataFrame, as_text: bool = False) -> DataFrame:
    """n_bytes, spans (start and length in bytes of what goes) and kept (the bytes that stay, or the text
    of whole characters) beside doc_id and the number of each row."""
    spark = docs.sparkSession
    parts = partitions(spark)
    texts = numbered(docs.select("doc_id", "text"))
    plain = texts.select(F.col("_row").alias("doc_id"), "text")
    counts = mapped(plain, _counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = texts.count()
    late = counts.filter(F.col("n") >= max(FREQUENT * total, MANY)).select("h").toArrow()["h"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(late.astype(np.int64).view(np.uint64)))
    dealt = mapped(plain, _dealt(frequent, parts), _PACKED).repartitionById(parts, "part")
    resolved = stored(mapped(dealt, _resolved, _PLACES))

    texts = texts.repartition(parts, "_row")
    asked = resolved.filter("part >= 0").groupBy(F.col("doc_id").alias("_row")).agg(F.collect_list(F.struct("part", "key", "at", "n")).alias("asked"))
    bodies = mapped(texts.join(asked, "_row").select(F.col("_row").alias("doc_id"), "text", "asked"), _bodies, "part int, key long, doc_id long, at int, body binary")
    more = mapped(bodies.repartitionById(parts, "part"), _compared, _PLACES)
    gone = resolved.filter("part < 0").union(more).groupBy(F.col("doc_id").alias("_row")).agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    joined = texts.join(gone, "_row", "left").select("doc_id", "_row", "text", F.coalesce("gone", F.array().cast("array<struct<at:int,n:int>>")).alias("gone"))
    return mapped(joined, _kept(as_text), f"doc_id long, _row long, n_bytes long, spans array<struct<at:long,n:long>>, kept {'string' if as_text else 'binary'}")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated bytes cut from the text; a character cut in part goes whole."""
    held = numbered(docs.select(F.struct("*").alias("own"), "doc_id", "text"))
    # The same numbers again: doc_id itself, or those of the stored rows.
    cut_ = repeated(held.select(F.col("_row").alias("doc_id"), "text"), as_text=True).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_row"), F.col("kept").alias("_text"))
    out = held.join(cut_, "_row", "left").withColumn("text", F.coalesce("_text", "text"))
    return out.select(*[F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns])


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.col("n_bytes") - F.length("kept")
    return rows.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
