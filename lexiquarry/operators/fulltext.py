"""Full-text search over postings: phrases, nearness, boolean queries, ladders and two BM25 forms.

The index is a table of postings (dict_id, id, col, term, pos). A query filters it by its terms
before anything is shuffled; documents meet by (dict_id, id); a phrase is a join on shifted positions, and
nearness one running window over a document's occurrences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions.fold import latin, tables
from lexiquarry.operators.ftsq import Near, Phrase, Query

TERM = r"[\p{L}\p{N}\p{M}]+"
DOC = ["dict_id", "id"]
_LATIN = dict(zip(*[tables("latin")[0][: len(tables("latin")[1])], tables("latin")[1]]))
_DROPPED = set(tables("latin")[0][len(tables("latin")[1]) :])


def latin_text(s: str) -> str:
    return "".join("" if c in _DROPPED else _LATIN.get(c, c) for c in s)


def terms_of(text: Column | str) -> Column:
    return F.regexp_extract_all(latin(text), F.lit(TERM), F.lit(0))


def postings(entries: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """One row a term and place. columns: index column to entry column."""
    out = None
    for name, source in (columns or {"txt": "body"}).items():
        rows = entries.select("dict_id", "id", F.lit(name).alias("col"), F.posexplode(terms_of(source)).alias("pos", "term"))
        out = rows if out is None else out.unionByName(rows)
    return out


def lengths(index: DataFrame) -> DataFrame:
    return index.groupBy(*DOC).agg(F.count(F.lit(1)).alias("len"))


def _is(term: str, open_: bool) -> Column:
    term = latin_text(term)
    return F.col("term").startswith(term) if open_ else F.col("term") == term


def occurrences(index: DataFrame, phrase: Phrase) -> DataFrame:
    """dict_id, id, col, at and n of every place where a phrase stands."""
    keys = ["dict_id", "id", "col"]
    last = len(phrase.terms) - 1
    parts = [index.filter(_is(t, phrase.open and k == last)).select(*keys, (F.col("pos") - k).alias("at")) for k, t in enumerate(phrase.terms)]
    return reduce(lambda a, b: a.join(b, [*keys, "at"]), parts).distinct().withColumn("n", F.lit(len(phrase.terms)))


def near(index: DataFrame, node: Near) -> DataFrame:
    """Documents where all phrases stand within a stretch, in any order, in one column."""
    found = [occurrences(index, p).withColumn("k", F.lit(k)) for k, p in enumerate(node.phrases)]
    rows = reduce(DataFrame.unionByName, found)
    w = Window.partitionBy("dict_id", "id", "col").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    lasts = [F.max(F.when(F.col("k") == k, F.struct("at", "n"))).over(w) for k in range(len(found))]
    rows = rows.select("*", *[x.alias(f"l{k}") for k, x in enumerate(lasts)])
    every = reduce(lambda a, b: a & b, [F.col(f"l{k}").isNotNull() for k in range(len(found))])
    ends = [F.col(f"l{k}.at") + F.col(f"l{k}.n") for k in range(len(found))]
    starts = [F.col(f"l{k}.at") for k in range(len(found))]
    if len(found) == 1:
        return rows.select(*DOC).distinct()
    first = F.array_min(F.array(*[F.struct(s.alias("s"), e.alias("e")) for s, e in zip(starts, ends)]))["e"]
    gap = F.greatest(*starts) - first
    return rows.filter(every & (gap <= node.within)).select(*DOC).distinct()


def matches(index: DataFrame, node: object) -> DataFrame:
    """dict_id and id of the documents that satisfy a query tree."""
    if isinstance(node, Phrase):
        if len(node.terms) == 1:
            return index.filter(_is(node.terms[0], node.open)).select(*DOC).distinct()
        return occurrences(index, node).select(*DOC).distinct()
    if isinstance(node, Near):
        return near(index, node)
    left, right = matches(index, node.left), matches(index, node.right)
    if node.kind == "or":
        return left.union(right).distinct()
    return left.join(right, DOC, "left_semi" if node.kind == "and" else "left_anti")


def ladder(index: DataFrame, query: Query) -> DataFrame:
    """dict_id, id and rung: each dictionary answers from its first rung that is not empty."""
    rows = reduce(DataFrame.unionByName, [matches(index, node).withColumn("rung", F.lit(i)) for i, (_, node) in enumerate(query.rungs)])
    first = Window.partitionBy("dict_id")
    names = F.array(*[F.lit(n) for n, _ in query.rungs])
    return rows.withColumn("best", F.min("rung").over(first)).filter("rung = best").select(*DOC, F.element_at(names, F.col("rung") + 1).alias("rung"))


def _statistics(index: DataFrame, terms: list[str], sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term counts by document, document counts by term and dictionary, sizes of dictionaries (from stored lengths, if there are any)."""
    folded = [latin_text(t) for t in terms]
    tf = index.filter(F.col("term").isin(folded)).groupBy("dict_id", "id", "term").agg(F.count(F.lit(1)).alias("wdf"))
    df = tf.groupBy(F.col("dict_id").alias("_d"), F.col("term").alias("_t")).agg(F.count(F.lit(1)).alias("df"))
    size = (lengths(index) if sizes is None else sizes).groupBy(F.col("dict_id").alias("_s")).agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean"))
    return tf, df, size


def bm25_lengths(index: DataFrame, terms: list[str], n: int) -> DataFrame:
    """Scores with document lengths (k1 = 1, b = 0.5, normalised length at least 0.5), the n best a dictionary."""
    tf, df, size = _statistics(index, terms)
    rows = tf.join(df, (F.col("dict_id") == F.col("_d")) & (F.col("term") == F.col("_t"))).join(F.broadcast(size), F.col("dict_id") == F.col("_s")).join(lengths(index), DOC)
    raw = (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    weight = F.log(F.when(raw < 2, raw * 0.5 + 1).otherwise(raw)) * 2.0
    norm = F.greatest(F.col("len") / F.col("mean"), F.lit(0.5))
    part = weight * F.col("wdf") / ((0.5 * norm + 0.5) + F.col("wdf"))
    return _best(rows.groupBy(*DOC).agg(F.round(F.sum(part), 6).alias("score")), n)


def bm25_terms(index: DataFrame, terms: list[str], n: int, k1: float = 1.2, sizes: DataFrame | None = None) -> DataFrame:
    """Scores by term counts and rarity alone, the n best a dictionary."""
    tf, df, size = _statistics(index, terms, sizes)
    rows = tf.join(df, (F.col("dict_id") == F.col("_d")) & (F.col("term") == F.col("_t"))).join(F.broadcast(size), F.col("dict_id") == F.col("_s"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.greatest(idf, F.lit(1e-6)) * F.col("wdf") * (k1 + 1) / (F.col("wdf") + k1)
    return _best(rows.groupBy(*DOC).agg(F.round(F.sum(part), 6).alias("score")), n)


def _best(scores: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("dict_id").orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("dict_id", "rank", "id", "score")


def expand(index: DataFrame, prefix: str, most: int = 256) -> DataFrame:
    """The first terms of each dictionary with a prefix, and whether there are more."""
    terms = index.filter(F.col("term").startswith(latin_text(prefix))).select("dict_id", "term").distinct()
    w = Window.partitionBy("dict_id")
    rows = terms.withColumn("k", F.row_number().over(w.orderBy("term"))).filter(F.col("k") <= most + 1)
    return rows.withColumn("more", F.max("k").over(w) > most).filter(F.col("k") <= most).select("dict_id", "term", "more")


def cjk_terms(text: Column) -> Column:
    """Single characters and pairs of neighbours of a run of CJK characters, in order."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.when(i < n, F.concat(F.element_at(chars, i), F.element_at(chars, i + 1))))
    return F.concat(chars, F.filter(pairs, lambda p: p.isNotNull()))
