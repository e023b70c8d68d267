"""Exact n-gram Jaccard join of whole texts, as connected components.

A document is the set of its distinct five-word shingles. Two documents link when
100 * intersection >= 75 * union. The join works on distinct sets ("nodes"), so
copies cost one row each and never pair up.

1. One pass over the texts gives each document its set size, its node and a
   bitmap signature: bit ``hash mod width`` is set for every shingle, where the
   width follows from the size band (powers of two). The same pass counts the shingles that
   several sets of a task hold; the most frequent of them come last in the order below.
2. Prefix index. In a fixed order of all shingles (frequent ones last, else by hash), sets
   that link share one of their first ``n - ceil(0.75 n) + 1`` shingles, and the first that they
   share leaves both with enough shingles to reach the overlap. A second pass deals those to tiles
   by shingle, packed by batch. Inside a tile, rows of one shingle are sorted by size; rows with no
   neighbour of a fitting size are dropped.
3. First round: only neighbours by size are compared. Their components hold most near copies.
4. Second round, for shingles with ``LARGE`` rows or more whose components still differ: each set goes to
   up to three of them, the largest; there, block by block, all pairs of differing components are
   compared, and only links that join two components are handed on.
5. Third round: inside each shingle's rows, every pair of fitting sizes and places whose
   components still differ and that did not meet in the second round is compared. No other pair can add a link.

A comparison first bounds the overlap from above by the bits in which the two
signatures differ, in the tile of the two size bands, and only then intersects the
sorted shingle arrays.

Defined cases: null and blank texts have no shingles, link with nothing and are
their own component; equal doc_ids are separate rows, that of a component being the least; null
doc_ids count as greater than all others and a component of only such rows has the id null; an empty
table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.functions.shipping import ship

from .common import cut, mapped, partitions, stored, table, text_buffers, told_apart
from .components import components
from .shingles import distinct, row_shingles

SHARE = (75, 100)
#: Shingles whose order follows their frequency, at most: 16 bytes each on every executor.
#: Any order gives the same links; one with the frequent shingles last compares fewer pairs.
ORDERED = 1 << 20
#: Rows of one shingle that are compared in blocks of BLOCK sets, at up to CHOSEN shingles a set.
LARGE, BLOCK, CHOSEN = 64, 1024, 3
#: Shingles that a task holds before it counts or deals them.
HELD = 1 << 18
#: Documents up to this number are sent to every executor (8 bytes each), beyond it joined.
SMALL_IDS = 1_000_000


def least_overlap(a: int, b: int) -> int:
    """The smallest intersection of linked sets of these sizes."""
    return -(-SHARE[0] * (a + b) // (SHARE[0] + SHARE[1]))


def prefix_length(n: int) -> int:
    return n - -(-SHARE[0] * n // SHARE[1]) + 1


def node_of(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set: among 10^12 sets two of one node have a chance under one in 10^14."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _column(nodes: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """Nodes (of type V16) as an Arrow column."""
    ends = np.arange(0, 16 * len(nodes) + 1, 16, dtype=np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(nodes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(nodes).tobytes())])
    return column if valid is None else pc.if_else(pa.array(valid), column, pa.scalar(None, pa.binary()))


def _halves(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(nodes).view(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _ranked(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The place of each node among the distinct ones in order, and those."""
    distinct_ = pa.array(sorted(pc.unique(column).to_pylist()), pa.binary())
    return pc.index_in(column, value_set=distinct_).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64), distinct_


def signature(shingles: np.ndarray) -> bytes:
    """Bitmap of 2 to 4 bits a shingle, as wide as the size band says."""
    width = max(64, 4 << (len(shingles).bit_length() - 1)) if len(shingles) else 64
    bits = np.zeros(width, np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(n: int, bits: bytes, m: int, other: bytes) -> int:
    """An upper bound of the overlap, at the width of the narrower band."""
    x, y = np.frombuffer(bits, np.uint64), np.frombuffer(other, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n, m, (n + m - int(np.bitwise_count(x ^ y).sum())) // 2)


def _often(sets: dict[bytes, np.ndarray]) -> pa.RecordBatch:
    """Shingles that several of these sets hold, with their counts."""
    words = np.sort(np.concatenate(list(sets.values()))) if sets else np.zeros(0, np.uint64)
    edge = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, np.int64)
    counts = np.diff(np.append(edge, len(words)))
    often = counts > 1
    token, count = words[edge][often].view(np.int64), counts[often]
    k = len(token)
    return pa.record_batch({"doc_id": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int64()), "node": pa.nulls(k, pa.binary()), "bits": pa.nulls(k, pa.binary()), "token": pa.array(token), "often": pa.array(count, pa.int64())})


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    every: dict[bytes, np.ndarray] = {}
    for batch in batches:
        n, nodes, bits = [], [], []
        for _, h in row_shingles(*text_buffers(batch["text"])):
            s = distinct(h)
            n.append(len(s))
            nodes.append(node_of(s) if len(s) else None)
            bits.append(signature(s) if len(s) else None)
            if len(s):
                every[nodes[-1]] = s
        rows = len(n)
        yield pa.record_batch({"doc_id": batch["doc_id"].cast(pa.int64()), "n": pa.array(n, pa.int64()), "node": pa.array(nodes, pa.binary()), "bits": pa.array(bits, pa.binary()), "token": pa.nulls(rows, pa.int64()), "often": pa.nulls(rows, pa.int64())})
        if sum(map(len, every.values())) >= HELD:
            yield _often(every)
            every = {}
    yield _often(every)


_DESCRIBED = "doc_id long, n long, node binary, bits binary, token long, often long"


def _prefixes(frequent, parts: int):
    """Packed (tile, shingle, node, size) of the prefixes of each batch's distinct sets."""

    def packed(tokens: list, nodes: list, sizes: list) -> Iterator[pa.RecordBatch]:
        t, z = np.concatenate(tokens), np.concatenate(sizes)
        d = np.repeat(np.frombuffer(b"".join(nodes), "V16"), [len(x) for x in tokens])
        at = np.concatenate([np.arange(len(x), dtype=np.int32) for x in tokens])
        tile = (t % np.uint64(parts)).astype(np.int32)
        # 32 bits of a shingle are enough inside a tile: two that share them only cause a comparison.
        rest = ((t // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(tile, kind="stable")
        tile, rest, d, z, at = tile[order], rest[order], d[order], z[order], at[order]
        cuts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1], [True])))
        pack = [(int(tile[i]), rest[i:j].tobytes(), d[i:j].tobytes(), z[i:j].tobytes(), at[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])]
        for i in range(0, len(pack), 64):
            to, *columns = zip(*pack[i : i + 64])
            yield pa.record_batch({"tile": pa.array(to, pa.int32())} | {c: pa.array(x, pa.binary()) for c, x in zip(("tokens", "nodes", "sizes", "places"), columns)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, rarity = frequent.value
        seen, tokens, nodes, sizes, held = set(), [], [], [], 0
        for batch in batches:
            for _, h in row_shingles(*text_buffers(batch["text"])):
                s = distinct(h)
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                most = prefix_length(len(s))
                if len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    is_late = late[at] == s
                    head = s[~is_late][:most]
                    if len(head) < most:
                        rest = np.argsort(rarity[at[is_late]], kind="stable")[: most - len(head)]
                        head = np.concatenate((head, s[is_late][rest]))
                else:
                    head = s[:most]
                tokens.append(head)
                nodes.append(node)
                sizes.append(np.full(len(head), len(s), np.int32))
                held += len(head)
            if held >= HELD:
                yield from packed(tokens, nodes, sizes)
                seen, tokens, nodes, sizes, held = set(), [], [], [], 0
        if held:
            yield from packed(tokens, nodes, sizes)

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shingles that several sets of fitting sizes share, each with its next neighbour by size."""
    keys, nodes, sizes, places = [], [], [], []
    for batch in batches:
        for tile, t, d, z, a in zip(*(batch[c].to_pylist() for c in ("tile", "tokens", "nodes", "sizes", "places"))):
            keys.append(np.frombuffer(t, np.uint32).astype(np.uint64) | np.uint64(tile << 32))
            nodes.append(np.frombuffer(d, "V16"))
            sizes.append(np.frombuffer(z, np.int32))
            places.append(np.frombuffer(a, np.int32))
    if not keys:
        return
    g, d, z, at = (np.concatenate(x) for x in (keys, nodes, sizes, places))
    del keys, nodes, sizes, places
    order = np.argsort(g, kind="stable")
    g = g[order]
    same = g[1:] == g[:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    order, g = order[shared], g[shared]
    d, z, at = d[order], z[order], at[order]
    order = np.lexsort((at, *_halves(d), z, g))
    g, d, z, at = g[order], d[order], z[order].astype(np.int64), at[order].astype(np.int64)
    fresh = np.ones(len(g), bool)
    low, high = _halves(d)
    fresh[1:] = (g[1:] != g[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    del low, high
    g, d, z, at = g[fresh], d[fresh], z[fresh], at[fresh]
    if len(g) < 2:
        return
    fits = (g[1:] == g[:-1]) & (SHARE[0] * z[1:] <= SHARE[1] * z[:-1])
    keep = np.append(fits, False) | np.concatenate(([False], fits))
    # A pair that the places rule out here is ruled out for this shingle alone.
    least = -(-SHARE[0] * (z[1:] + z[:-1]) // (SHARE[0] + SHARE[1]))
    fits &= (z[1:] - at[1:] >= least) & (z[:-1] - at[:-1] >= least)
    has = np.append(fits, False)
    following = np.concatenate((d[1:], np.zeros(1, "V16")))
    g, d, z, at, following, has = g[keep].view(np.int64), d[keep], z[keep], at[keep], following[keep], has[keep]
    for i in range(0, len(g), 1 << 16):
        s = slice(i, i + (1 << 16))
        yield pa.record_batch({"g": pa.array(g[s]), "node": _column(d[s]), "n": pa.array(z[s]), "place": pa.array(at[s]), "following": _column(following[s], has[s])})


def block_links(nodes: np.ndarray, sets: list[np.ndarray], bits: list[bytes], labels: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components among pairs of the two sides (or all, if there is one side). nodes and labels: numbers that stand for them."""
    parent = {int(x): int(x) for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = np.lexsort((nodes, [len(s) for s in sets]))
    nodes, labels, side = nodes[order], labels[order], side[order]
    sets, bits = [sets[i] for i in order], [bits[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    width = min(map(len, bits)) // 8
    rows = []
    for b in bits:
        x = np.frombuffer(b, np.uint64)
        while len(x) > width:
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        rows.append(x)
    signatures = np.stack(rows)
    one_side = len(np.unique(side)) == 1
    out = []
    for i in range(len(nodes) - 1):
        last = int(np.searchsorted(size, SHARE[1] * size[i] // SHARE[0], side="right"))
        rest = np.arange(i + 1, last)
        if not one_side:
            rest = rest[side[rest] != side[i]]
        if not len(rest):
            continue
        own = root(int(labels[i]))
        apart = np.array([root(int(labels[j])) != own for j in rest])
        rest = rest[apart]
        differ = np.bitwise_count(signatures[rest] ^ signatures[i]).sum(1)
        least = -(-SHARE[0] * (size[rest] + size[i]) // (SHARE[0] + SHARE[1]))
        can = (size[rest] + size[i] - differ) // 2 >= least
        for j, need in zip(rest[can], least[can]):
            if root(int(labels[j])) == root(int(labels[i])):
                continue
            a, b = sets[i], sets[j]
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            if int((b[at] == a).sum()) >= need:
                parent[root(int(labels[j]))] = root(int(labels[i]))
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def _blocks(table_):
    nodes, names = _ranked(table_["node"])
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table_["s"]]
    found = block_links(nodes, sets, table_["bits"].to_pylist(), _ranked(table_["label"])[0], table_["side"].to_numpy())
    return pa.table({"a": names.take(pa.array([x for x, _ in found], pa.int64())), "b": names.take(pa.array([y for _, y in found], pa.int64()))})


_OPEN = ("g", "node", "n", "place", "label", "c0", "c1", "c2")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs inside a shingle's rows that are still to be compared."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    (node, names), (label, _) = _ranked(rows["node"]), _ranked(rows["label"])
    g, n, place, *chosen = (rows[c].to_numpy() for c in _OPEN if c not in ("node", "label"))
    order = np.lexsort((n, g))
    g, node, n, place, label = g[order], node[order], n[order], place[order], label[order]
    chosen = np.stack(chosen, 1)[order]
    end = np.searchsorted(g, g, side="right")
    # Sizes rise inside a shingle's rows: the partners of a row are those up to the greatest fitting size.
    many = np.maximum(end - np.arange(len(g)) - 1, 0)
    i = 0
    while i < len(g):
        j = max(i + 1, int(np.searchsorted(np.cumsum(many[i:]), 1 << 20, side="right")) + i)
        first = np.repeat(np.arange(i, j), many[i:j])
        second = np.arange(len(first)) - np.repeat(np.cumsum(many[i:j]) - many[i:j], many[i:j]) + first + 1
        keep = (label[first] != label[second]) & (SHARE[0] * n[second] <= SHARE[1] * n[first])
        first, second = first[keep], second[keep]
        least = -(-SHARE[0] * (n[first] + n[second]) // (SHARE[0] + SHARE[1]))
        keep = (n[first] - place[first] >= least) & (n[second] - place[second] >= least)
        for a in range(CHOSEN):
            for b in range(CHOSEN):
                keep &= (chosen[first, a] != chosen[second, b]) | (chosen[first, a] == 0)
        x, y = node[first[keep]], node[second[keep]]
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
        yield pa.record_batch({"a": names.take(pa.array(pairs[:, 0])), "b": names.take(pa.array(pairs[:, 1]))})
        i = j


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = {k: batch[k].to_pylist() for k in ("n", "bits", "m", "other")}
        keep = [overlap_bound(n, x, m, y) >= least_overlap(n, m) for n, x, m, y in zip(c["n"], c["bits"], c["m"], c["other"])]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sets = [], []
        for _, h in row_shingles(*text_buffers(batch["text"])):
            s = distinct(h)
            if len(s):
                nodes.append(node_of(s))
                sets.append(s.tobytes())
            if len(sets) >= 256:
                yield pa.record_batch({"node": pa.array(nodes, pa.binary()), "s": pa.array(sets, pa.binary())})
                nodes, sets = [], []
        yield pa.record_batch({"node": pa.array(nodes, pa.binary()), "s": pa.array(sets, pa.binary())})


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch["x"], batch["y"]):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            keep.append(int((b[at] == a).sum()) >= least_overlap(len(a), len(b)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _node_sets(nodes: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The shingle arrays of the nodes asked for, from one document of each. nodes: node and doc_id of every set."""
    ids = cut(nodes.join(asked, "node", "left_semi").select("doc_id"))
    if ids.count() <= SMALL_IDS:
        ids = F.broadcast(ids)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    return mapped(texts, _sets, "node binary, s binary").groupBy("node").agg(F.first("s").alias("s"))


def _links(near: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, verified on their arrays."""
    sets = _node_sets(nodes, docs, near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    x = sets.select(F.col("node").alias("a"), F.col("s").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return mapped(near.join(x, "a").join(y, "b"), _verified, "a binary, b binary")


def _met_in_blocks(opened: DataFrame, nodes: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links that large shingles add, and c0, c1, c2: the shingles at which each set met the others."""
    large = opened.groupBy(F.col("g").alias("h")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= LARGE)
    own = Window.partitionBy("node").orderBy(F.desc("rows"), "g")
    chosen = opened.join(large, F.col("g") == F.col("h")).withColumn("k", F.row_number().over(own)).filter(F.col("k") <= CHOSEN)
    chosen = cut(chosen.select("g", "node", "label", "rows", "k"))
    met = chosen.groupBy("node").agg(*[F.coalesce(F.max(F.when(F.col("k") == i + 1, F.col("g"))), F.lit(0)).alias(f"c{i}") for i in range(CHOSEN)])
    sets = _node_sets(nodes, docs, chosen.select("node").distinct()).join(nodes.select("node", "bits"), "node")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    placed = chosen.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("g", "node", "label", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).join(sets, "node")
    ship(docs.sparkSession)
    return pairs.groupBy("g", "i", "j").applyInArrow(_blocks, "a binary, b binary").distinct(), met


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, and n_links: the links found from its
    set, which span its component but need not be all of them."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    described = stored(mapped(docs, _described, _DESCRIBED))
    rows = described.filter(F.col("n").isNotNull())
    often = described.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("often").alias("often"))
    often = stored(often)
    level = F.floor(F.log2("often")).cast("int")
    least, room = 64, ORDERED
    for step, many in often.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        room -= many
        if room < 0:
            break
        least = step
    late = often.filter(level >= least).select("token", "often").toArrow()
    tokens, counts = late["token"].to_numpy().astype(np.int64).view(np.uint64), late["often"].to_numpy()
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], counts[order]))
    parts = partitions(spark)
    packed = mapped(docs, _prefixes(frequent, parts), "tile int, tokens binary, nodes binary, sizes binary, places binary")
    shared = stored(mapped(packed.repartitionById(parts, "tile"), _tiles, "g long, node binary, n long, place long, following binary"))
    nodes = stored(rows.filter(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")))

    beside = cut(shared.filter(F.col("following").isNotNull()).select(F.least("node", "following").alias("a"), F.greatest("node", "following").alias("b")).distinct())
    left = nodes.select(F.col("node").alias("a"), "n", "bits")
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other"))

    def bounded(pairs: DataFrame) -> DataFrame:
        return cut(mapped(pairs.join(left, "a").join(right, "b"), _bounded, "a binary, b binary"))

    links = cut(_links(bounded(beside), nodes, docs))
    label = components(links)

    def still_open(label: DataFrame, rows: DataFrame) -> DataFrame:
        named = rows.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        differ = named.groupBy(F.col("g").alias("h")).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("h")
        return stored(named.join(differ, F.col("g") == F.col("h"), "left_semi"))

    opened = still_open(label, shared.select("g", "node", "n", "place"))
    more, met = _met_in_blocks(opened, nodes, docs)
    links = cut(links.union(more))
    label = components(links)
    opened = still_open(label, opened).join(met, "node", "left").fillna(0, ["c0", "c1", "c2"])
    # Where all rows met at one shingle, nothing is left.
    apart = opened.groupBy(F.col("g").alias("h")).agg(F.min("c0").alias("low"), F.max("c0").alias("high")).filter("low < high or low = 0").select("h")
    opened = opened.join(apart, F.col("g") == F.col("h"), "left_semi")
    across = mapped(opened.select(*_OPEN).repartition(parts, "g"), _across, "a binary, b binary").distinct().join(beside, ["a", "b"], "left_anti")
    last = cut(_links(bounded(across), nodes, docs))
    links = links.union(last)
    label = components(links) if last.count() else label
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    label = label.join(ends, "node", "left")

    placed = nodes.select("node", "doc_id").join(label, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    least = placed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(least, "label").select("node", "component_id", "n_links")
    return rows.join(placed, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, but of each component one row: that of the least doc_id, nulls last, and
    of equal doc_ids that of the least hash of the text (then any of the equal rows)."""
    held, by_id = told_apart(docs)
    placed = jaccard_components(held.select(F.col("_row").alias("doc_id"), F.col("own.text").alias("text")))
    if by_id:
        gone = placed.filter(F.col("doc_id") != F.col("component_id"))
    else:
        order = F.struct(F.col("own.doc_id").isNull().alias("none"), F.col("own.doc_id").alias("id"), F.xxhash64("own.text").alias("text"), F.col("_row"))
        placed = stored(placed.join(held.select("_row", order.alias("order")), F.col("doc_id") == F.col("_row")).select("doc_id", "component_id", "order"))
        stays = placed.groupBy("component_id").agg(F.min("order")["_row"].alias("stays"))
        gone = placed.join(stays, "component_id").filter(F.col("doc_id") != F.col("stays"))
    left = held.join(gone.select(F.col("doc_id").alias("_row")), "_row", "left_anti")
    return left.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text")).drop("n_links")


ORACLE_SQL = {
    "op4_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS set_ FROM w),
n AS (SELECT doc_id, len(set_)::BIGINT AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(set_) AS shingle FROM s),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT u.b AS doc_id, r.root FROM r JOIN u ON u.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, min(r.root)::BIGINT AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL"""
}
