"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each (key, shard) pair has a hash in (0, 1); a record goes to the shard with the
greatest ``weight / -ln(hash)``. A new shard can only win records for itself, so
growing from n to n + 1 shards moves about 1 / (n + 1) of the rows and no others.
Only DataFrame functions are used: the placement is a projection without a
shuffle, and places inside a shard are dealt in ``PLACES`` slices, so that no
task numbers a whole shard.

Defined cases: a null key hashes as the empty text (all null keys share a shard); a null text has
size 1 and checksum 0; equal keys go to one shard and get different slots; an
empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SHARDS = 8
#: Slices that number the rows of a shard; PLACES * shards offsets are all that is broadcast.
PLACES = 1024


def hash_unit(key: Column, salt: int | str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    head = F.conv(F.substring(F.md5(F.concat_ws("#", key, F.lit(str(salt)))), 1, 13), 16, 10)
    return (head.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard of a key: greatest weight / -ln(hash), ties to the smaller shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((F.lit(float(w)) / -F.log(hash_unit(text, s))).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights)]
    return -(F.array_max(F.array(*scores))["shard"])


def shard(docs: DataFrame, weights: list[float] | None = None, grown_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    weights = weights or [1.0] * SHARDS
    k = F.col(key)
    rows = docs.select(
        k.alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text)), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(k, weights).cast("int").alias("shard"),
        rendezvous(k, [*weights, grown_weight]).cast("int").alias("grown_shard"),
        F.conv(F.substring(F.md5(F.concat_ws("#", F.coalesce(k.cast("string"), F.lit("")), F.lit("place"))), 1, 4), 16, 10).cast("int").alias("_place"),
    )
    rows = rows.withColumn("_place", F.col("_place") % PLACES)
    # The counts read the keys alone; there are at most shards * PLACES of them.
    counts = docs.select(rendezvous(k, weights).cast("int").alias("shard"), (F.conv(F.substring(F.md5(F.concat_ws("#", F.coalesce(k.cast("string"), F.lit("")), F.lit("place"))), 1, 4), 16, 10).cast("int") % PLACES).alias("_place")).groupBy("shard", "_place").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_place", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy("shard", "_place").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("_k", F.row_number().over(own))
    placed = numbered.join(F.broadcast(starts), ["shard", "_place"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_k") - 1).cast("long").alias("slot"), "grown_shard")


def op5_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents", "doc_id", "text"))


def _unit_sql(salt: str) -> str:
    return f"((('0x' || substr(md5(k || '#{salt}'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def _shard_sql(n: int) -> str:
    scores = ", ".join(f"{{'score': 1.0::DOUBLE / -ln({_unit_sql(str(s))}), 'shard': {-s}}}" for s in range(n))
    return f"-(list_max([{scores}]).shard)"


ORACLE_SQL = {
    "op5_rendezvous": f"""
WITH bytes_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v
    FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT doc_id, k, (strlen(text) + 1)::BIGINT AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT),
        lambda a, b: xor(a >> 8, bytes_table.t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS text_crc32,
    ({_shard_sql(SHARDS)})::INTEGER AS shard, ({_shard_sql(SHARDS + 1)})::INTEGER AS grown_shard,
    (('0x' || substr(md5(k || '#place'), 1, 4))::INTEGER) % {PLACES} AS place
  FROM d, bytes_table)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM s"""
}
