"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped by length: a bin holds lengths within a few percent, and a bin
with many rows is split by a hash of the row, so that no bucket outgrows
``BUCKET_ROWS`` much, however many rows share one length. Queries come in blocks.
A first pass over the longest ``SEED_ROWS`` vectors or more (a slice of a bin with many) gives every query a score that its k-th
best cannot be below. With it, a (query, bucket) pair is skipped outright where
``|q| * longest < threshold``; what is left is joined block by bucket, and inside a
bucket each query picks the cheaper of two prunings from its local cosine threshold:

* length: only vectors of at least ``threshold / |q|`` can reach it;
* coordinate: a unit vector within that angle of the query has its focus
  coordinates inside a narrow interval, looked up in a sorted coordinate list.

Survivors are verified by exact integer products, so the result is exact. Components saturate at 2^62 and scores at the
bounds of a long. A bucket is sent once for each block of queries that has one to ask it, and to no other.

Defined cases: vectors that are null, empty, or hold null or non-finite components, and rows
with a null id, take no part; vectors of another dimension than the query's are
not its candidates; rows with the query's own id are never its candidates; a
query id that repeats is asked once, with its least vector; candidate ids that
repeat are ranked as often as they occur; ties go to the smaller id; empty
tables give an empty result. Columns besides the named ones are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.functions.shipping import ship

from .common import stored, table

K = 5
SCALE = 256
EVERY = 50
BUCKET_ROWS = 8192
BLOCK_QUERIES = 2048
#: Rows of the first pass, unless there are fewer; at most BUCKET_ROWS or so more.
SEED_ROWS = 4096
#: Focus coordinates that a query may prune by.
FOCUS = 4
_SATURATED = float(1 << 62)


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of every component, as long; saturates at 2^62."""
    return F.transform(vector, lambda x: F.greatest(F.lit(-_SATURATED), F.least(F.lit(_SATURATED), F.floor(x.cast("double") * SCALE).cast("double"))).cast("long"))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    rows = vectors.filter(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantised(v).alias("v"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    # About 3 % of length a bin; finite doubles span fewer than 2,900 bins.
    return rows.withColumn("bin", F.floor(F.log(F.col("norm") + 1.0) * 32).cast("int")).withColumn("dim", F.size("v"))


def _products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    most = float(np.abs(c).max(initial=0)) * float(np.abs(q).max(initial=0)) * c.shape[1]
    if most < 2.0**52:
        return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return c @ q
    exact = c.astype(object) @ q.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, int(x))) for x in exact], np.int64)


class Bucket:
    """Candidates of one bucket and one dimension, longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> None:
        order = np.argsort(-norms, kind="stable")
        self.ids, self.vectors, self.norms = ids[order], vectors[order], norms[order]
        self.units = self.vectors / np.maximum(self.norms, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.units[:, f], kind="stable")
            self.lists[f] = order, self.units[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, norm: float, least: float) -> np.ndarray | slice:
        """Rows that may reach the score ``least``."""
        n = len(self.ids)
        if not math.isfinite(least) or least <= 0 or norm == 0 or n == 0:
            return slice(0, n if norm * (self.norms[0] if n else 0) >= least else 0)
        need = least / norm * (1 - 1e-9)
        longest = self.norms[0]
        if longest < need:
            return slice(0, 0)
        by_length = int(np.searchsorted(-self.norms, -need, side="right"))
        cosine = need / longest
        unit = q / norm
        best, pick = by_length, None
        spread = math.sqrt(max(0.0, 1 - cosine * cosine))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            half = math.sqrt(max(0.0, 1 - unit[f] * unit[f])) * spread
            low, high = unit[f] * cosine - half - 1e-9, unit[f] * cosine + half + 1e-9
            # Beyond the query's own coordinate the angle can still shrink.
            if unit[f] >= cosine:
                high = 1.0
            if unit[f] <= -cosine:
                low = -1.0
            order, values = self.by(int(f))
            i, j = np.searchsorted(values, low, side="left"), np.searchsorted(values, high, side="right")
            if j - i < best:
                best, pick = int(j - i), order[i:j]
        return slice(0, by_length) if pick is None else pick

    def top(self, query_id: int, q: np.ndarray, norm: float, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.candidates(q, norm, least)
        ids, scores = self.ids[rows], _products(self.vectors[rows], q)
        keep = (ids != query_id) & (scores >= least)
        ids, scores = ids[keep], scores[keep]
        order = np.lexsort((ids, -scores))[:k]
        return ids[order], scores[order]


_FOUND = "query_id long, vec_id long, score long"


def _searcher(k: int):
    def search(queries: pd.DataFrame, bucket: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim, own in queries.groupby("dim"):
            rows = bucket[bucket["dim"] == dim]
            if not len(rows):
                continue
            b = Bucket(rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()), rows["norm"].to_numpy())
            for query_id, v, norm, least in zip(own["query_id"], own["v"], own["norm"], own["least"]):
                ids, scores = b.top(query_id, np.asarray(v), norm, least, k)
                out.append((np.full(len(ids), query_id), ids, scores))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        a, b_, c = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b_, "score": c})

    return search


def _searched(queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    ship(queries.sparkSession)
    keys = ["block", "bin", "split"]
    return queries.groupBy(*keys).cogroup(buckets.groupBy(*keys)).applyInPandas(_searcher(k), _FOUND)


def exact_topk(vectors: DataFrame, k: int = K, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows."""
    rows = stored(prepared(vectors, id_col, vector_col))
    asked = rows.filter(F.col("vec_id") % EVERY == 0 if is_query is None else is_query)
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "norm", "dim")).alias("q")).select("query_id", "q.*")
    # One row a bin, so at most a few thousand in all.
    bins = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).orderBy("bin").collect()
    n_blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    if not bins:
        return rows.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    splits = F.create_map(*[F.lit(x) for b in bins for x in (b["bin"], math.ceil(b["n"] / BUCKET_ROWS))])
    rows = rows.withColumn("split", F.pmod(F.xxhash64("vec_id", "v"), F.element_at(splits, F.col("bin"))).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))

    def dealt(pairs: DataFrame) -> DataFrame:
        """Query rows for each bucket they have to look at."""
        return pairs.withColumn("split", F.explode(F.sequence(F.lit(0), F.element_at(splits, F.col("bin")).cast("int") - 1)))

    # The longest bins, until there are rows enough; each in slices of about BUCKET_ROWS, of which one will do.
    seeds: list[int] = []
    while len(seeds) < len(bins) and sum(min(b["n"], BUCKET_ROWS) for b in bins[len(bins) - len(seeds) :]) < SEED_ROWS:
        seeds.append(bins[len(bins) - 1 - len(seeds)]["bin"])
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    longest = rows.filter(F.col("bin").isin(seeds) & (F.col("split") == 0)).withColumn("bin", F.lit(seeds[0])).select("*", blocks)
    first = _searched(asked.withColumns({"least": F.lit(float("-inf")), "bin": F.lit(seeds[0]), "split": F.lit(0)}), longest, k)
    least = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    least = least.select("query_id", F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(float("-inf")).alias("least"))
    asked = asked.join(least, "query_id", "left").fillna({"least": float("-inf")})
    by_bin = F.explode(F.array(*[F.struct(F.lit(b["bin"]).alias("bin"), F.lit(b["longest"]).alias("longest")) for b in bins]))
    pairs = asked.select("*", by_bin.alias("b")).select("*", "b.*").filter(F.col("norm") * F.col("longest") * (1 + 1e-9) >= F.col("least"))
    asking = dealt(pairs.drop("b", "longest"))
    # One row for each block that asks a bucket; both sides of the join are spread by bucket, of bounded size.
    keys = dealt(pairs.select("block", "bin").distinct()).toDF("block", "bin", "split")
    found = _searched(asking, rows.join(keys, ["bin", "split"]), k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE_SQL = {
    "op1_exact_topk": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= {K}"""
}
