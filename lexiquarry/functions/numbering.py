"""Row numbers inside a key without a sort of the whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, key: str, head: Column, order: list, name: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """The rows with their number, from 0, in an order inside a key; only those from start up to (not with) stop.

    head: a coarse part of the order (equal heads stand together, heads rise with the order). Rows are numbered inside
    a head; what stands before a head is a running sum over the counts of heads. Heads wholly outside the range are left out before
    anything is sorted."""
    rows = rows.withColumn("_head", head)
    ahead = Window.partitionBy("_d").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(F.col(key).alias("_d"), F.col("_head").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    heads = heads.withColumn("_base", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    if start > 0:
        heads = heads.filter(F.col("_base") + F.col("_n") > start)
    if stop is not None:
        heads = heads.filter(F.col("_base") < stop)
    own = Window.partitionBy(key, "_head").orderBy(*order)
    placed = rows.join(heads.drop("_n"), (F.col(key) == F.col("_d")) & (F.col("_head") == F.col("_h"))).withColumn("_k", F.row_number().over(own))
    placed = placed.withColumn(name, (F.col("_base") + F.col("_k") - 1).cast("long")).drop("_head", "_d", "_h", "_base", "_k")
    if start > 0:
        placed = placed.filter(F.col(name) >= start)
    return placed if stop is None else placed.filter(F.col(name) < stop)
