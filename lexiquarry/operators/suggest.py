"""One list of suggestions out of all dictionaries' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import fold as fo

MOST = 20


def suggested(keys: DataFrame, q: str, n: int = MOST) -> DataFrame:
    """rank and word in dictionary order: each word once but for case, in the spelling typed if a dictionary has it."""
    rows = keys.select(F.trim("key").alias("w")).filter("w <> ''").distinct().select("w", fo.lower1("w").alias("low"), *[c.alias(f"k{i}") for i, c in enumerate(fo.collation("w")[:3])])
    order = ["k0", "k1", "k2", "w"]
    own = Window.partitionBy("low")
    first = rows.withColumn("r", F.row_number().over(own.orderBy(*order))).withColumn("typed", F.max(F.when(F.col("w") == q, F.col("w"))).over(own)).filter("r = 1")
    # The cut comes before the numbering, so that one task numbers n rows at most.
    top = first.orderBy(*order).limit(n)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), F.coalesce("typed", "w").alias("word"))
