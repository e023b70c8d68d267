"""Benchmark decontamination: short test items found inside long documents.

Items and documents are sets of distinct five-word shingles (see ``shingles``); an item is
found in a document when at least ``100 * |both| >= 75 * |item|`` of its shingles occur there.

Size-partitioned MinHash search: the sketch of an item of n shingles is its
``n - ceil(0.75 n) + 1`` least hashes, so its length follows from the item's size, as
does the greatest hash in it. A document that contains 75 % of the item must hold one of them: the
search misses nothing, however long the document. Items are partitioned by size (powers of
two); for each partition a document is sketched by its hashes up to the partition's greatest
sketch value. Candidates are then verified by exact containment.

A benchmark whose shingles are at most ``SMALL_SHINGLES`` (checked by a count, 8 bytes
each) is sent to every executor and documents are searched in one scan without
a shuffle. A larger one is joined by sketch hash and counted by a second join.

Defined cases: items without words are found nowhere; an item of one to four words is
found only in documents that consist of just those words; null texts are empty;
equal doc_ids are searched as one document for each row; a null item_id is reported as null; equal items
are each reported; empty tables give an empty result; other columns are kept by
``clean`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import longs, mapped, stored, table, text_buffers, told_apart
from .shingles import distinct, row_shingles

SHARE = (75, 100)
SMALL_SHINGLES = 2_000_000

_FOUND = "doc_id long, item_id long, n_shared long, n_item long"


def needed(n: int) -> int:
    return -(-SHARE[0] * n // SHARE[1])


def sketch_length(n: int) -> int:
    return n - needed(n) + 1


class Index:
    """Sketches of the items by size partition, and their shingles."""

    def __init__(self, ids: list, sets: list[np.ndarray]) -> None:
        self.ids, self.sets = ids, sets
        size = np.array([len(s) for s in sets], np.int64)
        self.parts: list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in sorted({int(n).bit_length() for n in size if n}):
            own = [i for i, n in enumerate(size) if int(n).bit_length() == k]
            h = np.concatenate([sets[i][: sketch_length(len(sets[i]))] for i in own])
            item = np.concatenate([np.full(sketch_length(len(sets[i])), i) for i in own])
            order = np.argsort(h, kind="stable")
            h, item = h[order], item[order]
            gate = np.zeros(1 << 20, bool)
            gate[(h >> np.uint64(44)).astype(np.int64)] = True
            self.parts.append((h[-1], h, item, gate))

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Items that share a sketch hash with a document."""
        found = [np.zeros(0, np.int64)]
        for most, h, item, gate in self.parts:
            own = hashes[gate[(hashes >> np.uint64(44)).astype(np.int64)]]
            own = distinct(own[own <= most])
            if len(own):
                i, j = np.searchsorted(h, own, side="left"), np.searchsorted(h, own, side="right")
                found += [item[a:b] for a, b in zip(i, j) if b > a]
        return np.unique(np.concatenate(found))

    def contained(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, shared shingles, its shingles) of every item that a document contains."""
        items = self.candidates(hashes)
        if not len(items):
            return
        own = distinct(hashes)
        for i in items:
            s = self.sets[i]
            at = np.minimum(np.searchsorted(own, s), len(own) - 1)
            n = int((own[at] == s).sum())
            if SHARE[1] * n >= SHARE[0] * len(s):
                yield int(i), n, len(s)


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [distinct(h).tobytes() for _, h in row_shingles(*text_buffers(batch["text"]))]
        yield pa.record_batch({"item_id": batch["item_id"].cast(pa.int64()), "s": pa.array(sets, pa.binary())})


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets = shared.value
        index = Index(ids, [np.frombuffer(s, np.uint64) for s in sets])
        for batch in batches:
            doc = batch["doc_id"].cast(pa.int64())
            rows, items, many, size = [], [], [], []
            for r, h in row_shingles(*text_buffers(batch["text"])):
                for i, n, z in index.contained(h):
                    rows.append(r), items.append(ids[i]), many.append(n), size.append(z)
            yield pa.record_batch({"doc_id": doc.take(pa.array(rows, pa.int64())), "item_id": pa.array(items, pa.int64()), "n_shared": pa.array(many, pa.int64()), "n_item": pa.array(size, pa.int64())})

    return run


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct shingle; row tells the rows of equal ids apart."""
    for batch in batches:
        doc, row = longs(batch["doc_id"]), batch["row"].to_numpy()
        for r, h in row_shingles(*text_buffers(batch["text"])):
            s = distinct(h)
            yield pa.record_batch({"doc_id": pa.array(np.full(len(s), doc[r])), "row": pa.array(np.full(len(s), row[r])), "h": pa.array(s.view(np.int64))})


def _large(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The same search for benchmarks of any size: a join by sketch hash, then a count of shared shingles."""
    size = F.length("s") / 8
    shingles = items.withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", size.cast("long").alias("n"), "s")
    shingles = stored(mapped(shingles, _unpacked, "item long, item_id long, n long, h long, rank long"))
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    hashes = stored(mapped(rows, _hash_rows, "doc_id long, row long, h long"))
    sketches = shingles.filter(F.col("rank") < F.col("n") - F.ceil(F.col("n") * SHARE[0] / SHARE[1]) + 1)
    near = stored(hashes.join(sketches.select("item", "h"), "h").select("row", "item").distinct())
    both = near.join(shingles, "item").join(hashes, ["row", "h"]).groupBy("doc_id", "row", "item", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    both = both.filter(SHARE[1] * F.col("n_shared") >= SHARE[0] * F.col("n"))
    return both.select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "item_id", "n_shared", F.col("n").alias("n_item"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, item_id, n, s in zip(*(batch[c].to_pylist() for c in ("item", "item_id", "n", "s"))):
            h = np.frombuffer(s, np.int64)
            yield pa.record_batch({"item": pa.array([item] * n, pa.int64()), "item_id": pa.array([item_id] * n, pa.int64()), "n": pa.array([n] * n, pa.int64()), "h": pa.array(h), "rank": pa.array(np.arange(n))})


def contained_items(docs: DataFrame, benchmark: DataFrame, small: int = SMALL_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shared and n_item of every test item that a document contains."""
    spark = docs.sparkSession
    items = stored(mapped(benchmark.select("item_id", "text"), _item_sets, "item_id long, s binary").filter(F.length("s") > 0))
    total = items.agg(F.sum(F.length("s") / 8).cast("long")).first()[0] or 0
    if total > small:
        return _large(docs.select("doc_id", "text"), items)
    held = items.toArrow()
    shared = spark.sparkContext.broadcast((held["item_id"].to_pylist(), held["s"].to_pylist()))
    return mapped(docs.select("doc_id", "text"), _searched(shared), _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no test item, with all their columns; each row by itself, whatever its doc_id."""
    held, _ = told_apart(docs)
    found = contained_items(held.select(F.col("_row").alias("doc_id"), F.col("own.text").alias("text")), benchmark).select(F.col("doc_id").alias("_row")).distinct()
    left = held.join(found, "_row", "left_anti")
    return left.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def op7_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def _sets_sql(name: str, key: str) -> str:
    return f"""
  SELECT {key}, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN ['=' || array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS set_
  FROM (SELECT {key}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM {name})"""


ORACLE_SQL = {
    "op7_contained_items": f"""
WITH d AS ({_sets_sql("documents", "doc_id")}), i AS ({_sets_sql("benchmark", "item_id")}),
s AS (SELECT doc_id, unnest(set_) AS h FROM d), t AS (SELECT item_id, len(set_)::BIGINT AS n_item, unnest(set_) AS h FROM i),
b AS (SELECT doc_id, item_id, n_item, count(*)::BIGINT AS n_shared FROM s JOIN t USING (h) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item FROM b WHERE 100 * n_shared >= 75 * n_item"""
}
