"""Engine views over the driver's tables, as DataFrames and as SQL.

``entry`` (dict_id, id, w and its keys), ``alias`` (dict_id, row, w, entry_id) and ``doc_entry``
(dict_id, id, w, body) are what every dictionary operator works on. Each dictionary is a value
of dict_id, never a DataFrame of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions import fold as fo
from lexiquarry.functions.numbering import numbered

WORD = r"[\p{L}\p{M}]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def keyed(rows: DataFrame, w: str = "w") -> DataFrame:
    """The headword's comparison keys, computed once: fold_w, lower_w, nocase_w and cap_w."""
    return rows.select("*", fo.fold(w).alias("fold_w"), fo.lower1(w).alias("lower_w"), fo.nocase(w).alias("nocase_w"), fo.capmask(w).alias("cap_w"))


_HELD: dict[tuple[str, str, str], tuple[int, DataFrame]] = {}


def changed_at(spark: SparkSession, path: str) -> int:
    """When a file or folder was last written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getModificationTime()


def held(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A prepared table of a library (its store, its index): made once for a session and folder, and anew when its documents
    were written since; then read from Spark's cache, as a cluster would read the written tables of ``api.Library``."""
    key, now = (spark.sparkContext.applicationId, sf_dir, name), changed_at(spark, f"{sf_dir}/documents.parquet")
    if key in _HELD and _HELD[key][0] != now:
        _HELD.pop(key)[1].unpersist()
    if key not in _HELD:
        _HELD[key] = now, make().persist(StorageLevel.MEMORY_AND_DISK)
    return _HELD[key][1]


def store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entries and aliases with their keys."""
    entries = held(spark, sf_dir, "entry", lambda: keyed(entry(spark, sf_dir)))
    return entries, held(spark, sf_dir, "alias", lambda: keyed(alias(spark, sf_dir)))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "lang", "text")
    return docs.select(F.col("lang").alias("dict_id"), F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w")).distinct()


def headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dict_id, w and twin: the small-letter entry that a capitalised word is an alias of, else null."""
    t = tokens(spark, sf_dir).withColumn("low", fo.lower1("w"))
    twin = t.select(F.col("dict_id").alias("_d"), F.col("w").alias("_w"))
    return t.join(twin, (F.col("dict_id") == F.col("_d")) & (F.col("low") == F.col("_w")) & (F.col("low") != F.col("w")), "left").select("dict_id", "w", F.col("_w").alias("twin"))


def entry(spark: SparkSession, sf_dir: str, subs: bool = True) -> DataFrame:
    """Entries with ids in byte order of their words; every 20th word also has a sub-entry."""
    words = headwords(spark, sf_dir).filter(F.col("twin").isNull()).select("dict_id", "w")
    if subs:
        words = words.union(words.filter(F.pmod(F.octet_length("w"), F.lit(20)) == 7).select("dict_id", F.concat(F.lit("@"), "w")))
    return numbered(words, "dict_id", F.substring("w", 1, 2), ["w"], "pos").select("dict_id", (F.col("pos") + 1).alias("id"), "w")


def alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = headwords(spark, sf_dir).filter(F.col("twin").isNotNull())
    e = entry(spark, sf_dir).select(F.col("dict_id").alias("_d"), F.col("id").alias("entry_id"), F.col("w").alias("_w"))
    joined = rows.join(e, (F.col("dict_id") == F.col("_d")) & (F.col("twin") == F.col("_w")))
    placed = numbered(joined.select("dict_id", "w", "entry_id"), "dict_id", F.substring("w", 1, 2), ["w"], "pos")
    return placed.select("dict_id", (F.col("pos") + 1).alias("row"), "w", "entry_id")


def doc_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: dict_id is the source, the headword the first word."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return docs.select(F.col("source").alias("dict_id"), F.col("doc_id").alias("id"), F.regexp_extract("text", WORD, 0).alias("w"), F.col("text").alias("body"))


# The same views as SQL, each a list of common table expressions.

HEAD_SQL = rf"""
token AS MATERIALIZED (SELECT DISTINCT lang AS dict_id, unnest(regexp_extract_all(text, '{WORD}')) AS w FROM documents),
low AS MATERIALIZED (SELECT dict_id, w, {fo.translate_sql("w", "lower")} AS low FROM token),
head AS MATERIALIZED (SELECT l.dict_id, l.w, t.w AS twin FROM low l LEFT JOIN token t ON t.dict_id = l.dict_id AND t.w = l.low AND l.low <> l.w),
words AS MATERIALIZED (SELECT dict_id, w FROM head WHERE twin IS NULL UNION ALL SELECT dict_id, '@' || w FROM head WHERE twin IS NULL AND strlen(w) % 20 = 7),
entry AS MATERIALIZED (SELECT dict_id, row_number() OVER (PARTITION BY dict_id ORDER BY w)::BIGINT AS id, w FROM words),
alias AS MATERIALIZED (SELECT h.dict_id, row_number() OVER (PARTITION BY h.dict_id ORDER BY h.w)::BIGINT AS row, h.w, e.id AS entry_id
  FROM head h JOIN entry e ON e.dict_id = h.dict_id AND e.w = h.twin)"""

DOC_SQL = rf"""
doc_entry AS (SELECT source AS dict_id, doc_id AS id, regexp_extract(text, '{WORD}') AS w, text AS body FROM documents)"""


def keyed_sql(source: str, columns: str = "*") -> str:
    return f"""SELECT {columns}, {fo.translate_sql("w", "fold")} AS fold_w, {fo.translate_sql("w", "lower")} AS lower_w, {fo.translate_sql("w", "nocase")} AS nocase_w, {fo.capmask_sql("w")} AS cap_w FROM {source}"""
