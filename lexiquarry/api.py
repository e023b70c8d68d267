"""The library as one object: entries, aliases and dictionaries, and the searches over them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiquarry.operators import articles, browse, ftsq, fulltext, headword, library, suggest
from lexiquarry.operators.pattern import PatternTooLong
from lexiquarry.plans.views import keyed

#: Slices of the postings of a stretch of terms: no task writes all of a frequent one.
INDEX_SLICES = 16
MODES = ("exact", "prefix", "wildcard", "fts")


def parse_mode(text: str | None) -> str:
    """A search mode by name; prefix is the default and also called fuzzy."""
    low = (text or "prefix").strip().lower()
    return {"fuzzy": "prefix", "": "prefix", "fulltext": "fts"}.get(low, low if low in MODES else "prefix")


class Library:
    """Entries and aliases with their keys, and the full-text index where one is stored: postings and, beside them, the number
    of terms of each document. Without a stored index, full-text search builds what it needs from the bodies."""

    index: DataFrame | None = None
    lengths: DataFrame | None = None

    def __init__(self, entries: DataFrame, aliases: DataFrame) -> None:
        self.entries, self.aliases = keyed(entries), keyed(aliases)

    @classmethod
    def of_records(cls, raw: DataFrame) -> Library:
        """Ingest raw records; redirects become aliases of what they lead to."""
        entries, aliases, links = library.ingest(raw)
        led = library.resolve_redirects(entries, links).filter(F.col("entry_id").isNotNull())
        more = led.select("dict_id", (F.col("seq") + (1 << 40)).alias("row"), "w", "entry_id")
        return cls(entries, aliases.unionByName(more))

    def write(self, path: str, index: bool = True) -> None:
        """The store: entries and aliases by dictionary, in key order so that a prefix skips row groups, and the full-text index."""
        for name, rows in (("entry", self.entries), ("alias", self.aliases)):
            rows.repartition("dict_id", F.substring("fold_w", 1, 2)).sortWithinPartitions("dict_id", "fold_w").write.mode("overwrite").option("compression", "zstd").partitionBy("dict_id").parquet(f"{path}/{name}")
        if index:
            self.write_index(path)

    def write_index(self, path: str) -> None:
        """Postings by dictionary, in the order of terms and spread by them, so that a search for a term reads few row groups of few
        files; and the lengths of documents."""
        rows = self._postings(self.entries.filter(~headword.is_sub()))
        spread = rows.repartition("dict_id", F.substring("term", 1, 3), F.pmod(F.xxhash64("id"), F.lit(INDEX_SLICES)))
        spread.sortWithinPartitions("dict_id", "term", "id").write.mode("overwrite").option("compression", "zstd").partitionBy("dict_id").parquet(f"{path}/postings")
        fulltext.lengths(rows).write.mode("overwrite").option("compression", "zstd").partitionBy("dict_id").parquet(f"{path}/lengths")

    @staticmethod
    def drop_index(spark: SparkSession, path: str) -> bool:
        """Delete the stored full-text index, and only that; whether there was one."""
        found = False
        for name in ("postings", "lengths"):
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            found |= folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return found

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Library:
        out = cls.__new__(cls)
        # Schemas are stated: a table may have no file, and names of dictionaries that look like numbers stay text.
        empty = lambda columns: spark.createDataFrame([], f"{columns}, dict_id string")
        read = lambda name, like: spark.read.schema(like.schema).parquet(f"{path}/{name}")
        out.entries, out.aliases = read("entry", keyed(empty("id long, w string, body string"))), read("alias", keyed(empty("row long, w string, entry_id long")))
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/postings")
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            out.index, out.lengths = read("postings", empty("id long, col string, pos int, term string")), read("lengths", empty("id long, len long"))
        return out

    @staticmethod
    def _postings(shown: DataFrame) -> DataFrame:
        return fulltext.postings(shown.withColumn("body", F.regexp_replace("body", r"(?s)<[^>]*>", " ")), {"w": "w", "txt": "body"})

    def _scoped(self, dictionaries: list[str] | None) -> tuple[DataFrame, DataFrame]:
        if dictionaries is None:
            return self.entries, self.aliases
        own = F.col("dict_id").isin(dictionaries)
        return self.entries.filter(own), self.aliases.filter(own)

    def search(self, text: str, mode: str = "prefix", n: int = 20, dictionaries: list[str] | None = None, marks: bool = False) -> DataFrame:
        """dict_id, rank, id, key and body of the best entries of each dictionary."""
        e, a = self._scoped(dictionaries)
        mode = parse_mode(mode)
        if mode == "fts":
            return self._full_text(e, text, n, marks, dictionaries)
        try:
            hits = {"exact": lambda: headword.exact(e, a, text, n), "prefix": lambda: headword.prefix(e, a, text, n), "wildcard": lambda: headword.wildcard(e, text, n)}[mode]()
        except PatternTooLong:
            hits = headword.exact(e.limit(0), None, text, n)
        return headword.with_headword(hits, e, "body")

    def _full_text(self, e: DataFrame, text: str, n: int, marks: bool, dictionaries: list[str] | None = None) -> DataFrame:
        q = ftsq.parse(text)
        shown = e.filter(~headword.is_sub())
        if not q.rungs:
            return shown.limit(0).select("dict_id", F.lit(0).alias("rank"), "id", F.col("w").alias("headword"), "body", F.lit("").alias("rung"))
        index, sizes = self.index, self.lengths
        if index is None:
            index = self._postings(shown)
        elif dictionaries is not None:
            index, sizes = (x.filter(F.col("dict_id").isin(dictionaries)) for x in (index, sizes))
        found = fulltext.ladder(index, q)
        terms = sorted({t for p in ftsq.marks(q.rungs[0][1]) for t in p.terms})
        scores = fulltext.bm25_terms(index, terms, 1 << 30, sizes=sizes).select("dict_id", "id", "score")
        w = Window.partitionBy("dict_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "id")
        top = found.join(scores, ["dict_id", "id"], "left").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= headword.clamp(n))
        out = headword.with_headword(top.select("dict_id", "rank", "id", "rung"), shown, "body")
        if marks:
            marker = articles.Marker([(p.terms, p.open) for p in ftsq.marks(q.rungs[0][1])])
            out = articles.mapped_column(out, "body", "body", marker.mark)
        return out

    def suggest(self, text: str, n: int = 20) -> list[str]:
        return [r["word"] for r in suggest.suggested(headword.prefix(self.entries, self.aliases, text, n), text, n).orderBy("rank").collect()]

    def browse(self, dict_id: str, word: str = "", size: int = browse.PAGE_ROWS) -> DataFrame:
        """The page of a dictionary that a word falls on."""
        own = self.entries.filter(F.col("dict_id") == dict_id)
        total = browse.visible(own).count()
        at = browse.jump(own, word).first()
        start, rows = browse.response(total, at["offset"] if at and word else 0, size)
        return browse.page(own, start, rows)

    def alphabet(self) -> DataFrame:
        return browse.alphabet(self.entries)

    def stream(self, hits: DataFrame) -> Iterator[str]:
        """NDJSON lines, a partition at a time."""
        for row in library.ndjson(hits, [c for c in hits.columns]).toLocalIterator():
            yield row["line"]
