"""Look-up history kept by a stream: an addition to the batch form in ``operators.library.history``.

Events are deduplicated by id inside a watermark; each micro-batch then moves its words to the front of a
history table that is replaced as a whole, so a batch that runs again leaves the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.operators.library import HISTORY_MOST, history


def lookups(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """ts, seq and word of each look-up once."""
    rows = events.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("word"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])


def keep_history(stream: DataFrame, table_path: str, checkpoint: str, most: int = HISTORY_MOST):
    """Start the query that keeps the newest words in versions of a table; ``newest`` reads the last one."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = newest(spark, table_path, number - 1)
        rows = batch.select("seq", "ts", "word")
        if old is not None:
            rows = rows.unionByName(old.select("seq", "ts", "word"))
        kept = history(rows, most).join(rows.groupBy("word").agg(F.max("ts").alias("ts"), F.max("seq").alias("seq")), "word")
        kept.write.mode("overwrite").parquet(f"{table_path}/v={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, table_path: str, up_to: int | None = None) -> DataFrame | None:
    """The last version of a history table at or before a batch, None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]
    found = [v for v in found if (up_to is None or v <= up_to) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/v={v}/_SUCCESS"))]
    return spark.read.parquet(f"{table_path}/v={max(found)}") if found else None
