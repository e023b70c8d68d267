"""Connected components of an edge table.

Each task first joins the edges that it reads, and hands on a star for each of its components: a node is in at most
one edge a task then. Up to ``AT_ONCE`` of those edges are joined by one task. More of them go through rounds of
alternating large and small stars, on all executors.

The edges never leave the executors. What is joined, and every round, is written as a reliable checkpoint, so
that nothing depends on the lineage, or the executors, of what came before. A round is some ten stages, whose plans and tasks
the driver keeps for a while: few edges are not worth that."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, partitions

#: Edges that one task of a round handles at least: few edges are not spread over many small files.
EDGES = 100_000
#: Edges that one task joins alone, at most.
AT_ONCE = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes, from edges between their numbers."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges (a, b) but the least of its component, as a, beside that one, as b."""
    held = [x for x in batches if x.num_rows]
    if not held:
        return
    edges = pa.Table.from_batches(held)
    del held
    nodes = pc.unique(pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]))
    nodes = nodes.take(pc.sort_indices(nodes))
    a, b = (pc.index_in(edges[c], value_set=nodes).combine_chunks().to_numpy().astype(np.int64) for c in ("a", "b"))
    label = least_labels(a, b, len(nodes))
    other = np.flatnonzero(label != np.arange(len(nodes)))
    for i in range(0, len(other), 1 << 16):
        s = other[i : i + (1 << 16)]
        yield pa.record_batch({"a": nodes.take(pa.array(s)), "b": nodes.take(pa.array(label[s]))})


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Point each neighbour at the least node it can see. parts: tasks that are enough for the edges."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    both = both.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts)
    pairs = both.join(least, F.col("u") == F.col("w")).coalesce(parts)
    if large:
        out = pairs.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = pairs.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct().coalesce(parts)


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node of its component, of every node that has an edge (a, b)."""
    e = cut(mapped(edges.filter(F.col("a") != F.col("b")).select("a", "b"), _joined, edges.select("a", "b").schema))
    seen = _digest(e)
    if seen[0] <= AT_ONCE:
        e = cut(mapped(e.coalesce(1), _joined, e.schema))
        seen = (0,)
    while seen[0]:
        parts = max(1, min(partitions(e.sparkSession), -(-seen[0] // EDGES)))
        e = e.coalesce(parts)
        e = cut(_stars(_stars(e, True, parts), False, parts))
        now = _digest(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b"), F.col("b"))).distinct()
