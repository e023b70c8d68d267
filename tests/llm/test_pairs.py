"""Search, joins, deduplication, decontamination and sharding against brute force and on odd input."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lexiquarry.llm import common, components, decontaminate, jaccard, queries, sharding, substrings, topk
from lexiquarry.llm.suffixes import permuted_prefixes, suffix_array
from tests.parity import connect, rows_of_spark, rows_of_sql

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, None), (8, "é É \x0b x y z"), (9, "w " * 40_000), (10, "x" * 100_000)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    assert rows_of_spark(queries.QUERIES[name](spark, FOLDER)) == rows_of_sql(connect(FOLDER), queries.ORACLE_SQL[name])


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def words(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 90))] for _ in range(5)]
    rows = {}
    for _ in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            b[rng.randrange(len(b))] = rng.choice("xyz") * 2
        rows[rng.randint(-(10**6), 10**6)] = " ".join(b[: rng.randint(0, len(b))] if rng.random() < 0.2 else b)
    return list(rows.items())


@pytest.mark.parametrize("large", [4, 64])
def test_jaccard_components(spark, large, monkeypatch):
    monkeypatch.setattr(jaccard, "LARGE", large)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rows = near_copies(large, 150)
    sets = {i: words(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_odd_rows(spark):
    assert jaccard.jaccard_components(empty(spark, DOCS)).count() == 0
    frame = spark.createDataFrame(ODD, DOCS).withColumn("node", F.lit("clash")).withColumn("n", F.lit(None).cast("int"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame).collect()), key=str)
    assert len(got) == len(ODD)
    assert (4, 1, 4) in got and (5, 1, 4) in got and (2, 0, 2) in got and got.count((7, 1, 7)) == 2 and (None, 1, 7) in got and (None, 0, None) in got
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 6, 7}


ROWS = [(None, "p q r s t u"), (None, "k l m n o p"), (None, None), (None, None), (7, "p q r s t u"), (7, "v w x y z a"), (7, "v w x y z a"), (3, "c c d d e e"), (3, "c c d d e e"), (3, "f f g g h h"), (None, "i i j j k k"), (None, "i i j j k k")]


def test_one_of_each_goes_by_row(spark):
    left = jaccard.one_of_each(spark.createDataFrame(ROWS, DOCS).withColumn("_row", F.lit("clash")))
    assert left.columns == ["doc_id", "text", "_row"]
    want = [(None, "k l m n o p"), (None, None), (None, None), (7, "p q r s t u"), (7, "v w x y z a"), (3, "c c d d e e"), (3, "f f g g h h"), (None, "i i j j k k")]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(want, key=str)
    odd = [(r.doc_id, r.text) for r in jaccard.one_of_each(spark.createDataFrame(ODD, DOCS)).collect()]
    assert (None, None) in odd and (None, "a b c d e") not in odd and odd.count((7, "a b c d e")) == 1


@pytest.mark.parametrize("small", [decontaminate.SMALL_SHINGLES, 0])
def test_decontamination_goes_by_row(spark, small, monkeypatch):
    monkeypatch.setattr(decontaminate.contained_items, "__defaults__", (small,))
    items = spark.createDataFrame([(1, "p q r s t u"), (2, "c c d d e e")], "item_id long, text string")
    left = decontaminate.clean(spark.createDataFrame(ROWS, DOCS).withColumn("_row", F.lit("clash")), items)
    assert left.columns == ["doc_id", "text", "_row"]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted((r for r in ROWS if r[1] not in ("p q r s t u", "c c d d e e")), key=str)


def test_suffix_array():
    import numpy as np

    rng = random.Random(4)
    for _ in range(150):
        s = bytes(rng.choice(b"ab\x00\xffc"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 50))) * rng.choice([1, 3])
        a = np.frombuffer(s, np.uint8)
        sa = suffix_array(a)
        order = sorted(range(len(s)), key=lambda i: s[i:])
        assert sa.tolist() == order
        shared = permuted_prefixes(a, sa, 10)
        for x, y in zip(order, order[1:]):
            n = 0
            while n < 10 and max(x, y) + n < len(s) and s[x + n] == s[y + n]:
                n += 1
            assert shared[y] == n


def kept_of(text):
    b, seen, gone = text.encode(), set(), set()
    for s in range(len(b) - 99):
        if b[s : s + 100] in seen:
            gone.update(range(s, s + 100))
        seen.add(b[s : s + 100])
    return len(bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore"))


def test_runs_of_very_many_documents():
    import numpy as np

    n = 9_000_000
    doc, at, many = substrings.merged(np.arange(n)[::-1].copy(), np.full(n, 5, np.int32), np.full(n, 3, np.int32))
    assert len(doc) == n and doc[-1] == n - 1 and (at == 5).all() and (many == 3).all()
    got = substrings.merged(np.array([2, 1, 1, 1]), np.array([5, 0, 3, 9], np.int32), np.array([1, 3, 2, 1], np.int32))
    assert [x.tolist() for x in got] == [[1, 1, 2], [0, 9, 5], [5, 1, 1]]


def thue_morse(k):
    t = b"a"
    for _ in range(k):
        t += bytes(195 - x for x in t)
    return t


def test_hashes_of_thue_morse_words(spark):
    """Two words on which every sum of powers modulo 2^64 is equal are told apart."""
    import numpy as np

    from lexiquarry.llm.shingles import word_hashes

    x = thue_morse(11)
    y = bytes(195 - c for c in x)
    h, _ = word_hashes(np.frombuffer(x + b" " + y + b" " + x, np.uint8), np.array([0, 3 * len(x) + 2]))
    assert h[0] == h[2] != h[1]
    rows = [(1, " ".join([x.decode()] + ["w%d" % i for i in range(5)])), (2, " ".join([y.decode()] + ["w%d" % i for i in range(5)]))]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 2}
    cut = {r.doc_id: len(r.kept) for r in substrings.repeated(spark.createDataFrame([(1, x.decode()), (2, y.decode())], DOCS)).collect()}
    assert cut == {i: n - k for i, (n, k, _, _) in cut_brute([(1, x.decode()), (2, y.decode())]).items()}


def cut_brute(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), len(b) - len(kept), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("many", [5000, 4])
def test_repeated_bytes(spark, many, monkeypatch):
    monkeypatch.setattr(substrings, "MANY", many)
    rng = random.Random(many)
    base = "".join(rng.choice("ab cdé") for _ in range(2000))
    rows = {}
    for i in range(90):
        a = rng.randint(0, 1700)
        t = base[a : a + rng.randint(0, 300)]
        if i % 7 == 0:
            t = rng.choice(["x", "ab", "abc "]) * rng.randint(40, 300)
        if i % 5 == 0:
            t = t + base[:150] + t
        rows[rng.choice([i, i * 1000, -i])] = t if i % 11 else None
    frame = spark.createDataFrame(list(rows.items()), DOCS)
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.repeated(frame).collect()}
    assert got == cut_brute(list(rows.items()))


def test_repeated_bytes_of_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.op3_repeated_bytes(spark, FOLDER).collect()}
    assert got == cut_brute(rows)


def test_repeated_bytes_odd_rows(spark):
    assert substrings.repeated(empty(spark, DOCS)).count() == 0
    frame = spark.createDataFrame(ODD, DOCS).withColumn("at", F.lit(1)).withColumn("_row", F.lit("clash"))
    assert substrings.repeated(frame).count() == len(ODD)
    twice = spark.createDataFrame([(1, "a" * 150), (1, "a" * 150), (None, "é" * 99)], DOCS)
    out = substrings.without_repeats(twice.withColumn("extra", F.lit(None).cast("int")))
    assert out.columns == ["doc_id", "text", "extra"]
    # The first text keeps its first byte, the row of the same id goes whole.
    assert sorted(len(r.text) for r in out.collect()) == sorted([kept_of("a" * 150), 0, kept_of("é" * 99)]) == [0, 1, 1]


def test_decontamination(spark):
    rng = random.Random(8)
    pool = [rng.choice("abcdefghijkl") * rng.randint(1, 4) for _ in range(60)]
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 5, 9, 30])))) for k in range(40)] + [(99, None), (None, "a b c d e f")]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    for i in range(60):
        w = rng.choice(items)[1] or ""
        if i % 2:
            w = w.split()
            if w and i % 3 == 0:
                w[rng.randrange(len(w))] = "zz"
            docs[i] = (i, docs[i][1] + " " + " ".join(w).upper() + " " + docs[i][1][:50])
    docs += [(100, items[3][1]), (101, None), (101, "")]
    want = set()
    for i, t in docs:
        d = words(t)
        for k, u in items:
            s = words(u)
            n = len(s & d) if len((u or "").split()) >= 5 else (1 if s and s == d else 0)
            if s and 100 * n >= 75 * len(s):
                want.add((i, k, n, len(s)))
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for small in (decontaminate.SMALL_SHINGLES, 0):
        got = {tuple(r) for r in decontaminate.contained_items(frame, bench, small).select("doc_id", "item_id", "n_shared", "n_item").collect()}
        assert got == want
    left = decontaminate.clean(frame.withColumn("item_id", F.lit("clash")), bench)
    assert left.columns == ["doc_id", "text", "item_id"] and {r.doc_id for r in left.collect()} == {i for i, _ in docs} - {w[0] for w in want}
    assert decontaminate.contained_items(empty(spark, DOCS), bench).count() == 0
    assert decontaminate.contained_items(frame, empty(spark, "item_id long, text string")).count() == 0
    found = decontaminate.contained_items(spark.createDataFrame(ODD, DOCS), spark.createDataFrame([(1, "W w w w w w"), (2, "one"), (3, "x" * 100_000)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(9, 1), (4, 2), (5, 2), (10, 3)}


def test_topk_equals_brute_force(spark, monkeypatch):
    import math

    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 9) for _ in range(6)]) for i in range(240)] + [(300, [0.5] * 6), (301, [0.5] * 6), (302, [0.5] * 6), (350, [0.0] * 6), (351, [900.0] * 6)]
    rows += [(50, None), (100, [1.0, None]), (150, [float("nan")] * 6), (400, [float("inf")] * 6), (450, []), (500, [1.0, 2.0]), (None, [1.0] * 6), (301, [0.5] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("bin", F.lit(1))
    import struct

    f32 = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    good = [(i, [math.floor(256 * f32(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for q, v in good:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good if c != q and len(w) == len(v))[:5]
            for rank, (s, c) in enumerate(found, 1):
                want[q, rank] = (c, -s)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    for size, seeds in ((16, 1), (16, 40), (topk.BUCKET_ROWS, topk.SEED_ROWS)):
        monkeypatch.setattr(topk, "SEED_ROWS", seeds)
        old, topk.BUCKET_ROWS = topk.BUCKET_ROWS, size
        try:
            got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_topk(frame).collect()}
        finally:
            topk.BUCKET_ROWS = old
        assert got == want
    assert topk.exact_topk(empty(spark, "vec_id long, embedding array<float>")).count() == 0


def test_sharding(spark):
    frame = spark.createDataFrame([*ODD, *[(i, "t") for i in range(100, 1100)]], DOCS).withColumn("shard", F.lit("clash"))
    rows = sharding.shard(frame).collect()
    assert len(rows) == len(ODD) + 1000
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
        assert 80 < len(slots) < 180
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 7}) == 1
    heavy = sharding.shard(frame, weights=[1.0] * 3 + [5.0]).groupBy("shard").count().collect()
    assert max(heavy, key=lambda r: r["count"]).shard == 3
    assert sharding.shard(empty(spark, DOCS)).count() == 0


@pytest.mark.parametrize("at_once", [10**6, 0])
def test_components(spark, at_once, monkeypatch):
    """Least nodes of components, by one task and by rounds; few edges take few jobs, however long their chains."""
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(300) if k % 100] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7), (5000, 5000), (90, 10), (90, 10)]
    name = lambda k: hashlib.md5(str(k).encode()).digest()
    root = {name(k): name(k) for e in edges for k in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(name(a)), find(name(b))))
            root[y] = x
    frame = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary").repartition(7)
    spark.sparkContext.setJobGroup(f"components {at_once}", "")
    got = [(bytes(r.node), bytes(r.label)) for r in components.components(frame).collect()]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(got) == sorted((k, find(k)) for k in root)
    assert components.components(empty(spark, "a binary, b binary")).count() == 0
    if at_once:
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components {at_once}")) <= 12


def test_the_driver_gives_memory_back(spark, monkeypatch):
    """After each written table and checkpoint, whatever freed memory its JVM holds outside the heap."""
    assert common.trim_driver(spark)
    calls = []
    monkeypatch.setattr(common, "trim_driver", calls.append)
    assert common.cut(common.stored(spark.range(3))).count() == 3 and len(calls) == 2
