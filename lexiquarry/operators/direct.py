"""Operators over dictionaries that are searched without a prepared store, lemma lookups and small classifiers."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import fold as fo

#: Windows language ids by their primary part (the low ten bits).
PRIMARY = {1: "ar", 2: "bg", 3: "ca", 4: "zh", 5: "cs", 6: "da", 7: "de", 8: "el", 9: "en", 10: "es", 11: "fi", 12: "fr", 13: "he", 14: "hu", 15: "is", 16: "it", 17: "ja", 18: "ko", 19: "nl", 20: "no", 21: "pl", 22: "pt", 24: "ro", 25: "ru", 26: "hr", 27: "sk", 29: "sv", 31: "tr", 34: "uk", 36: "sl", 41: "fa", 57: "hi"}
#: Whole ids that say more than their primary part.
WHOLE = {2052: "zh-CN", 1028: "zh-TW", 1046: "pt-BR", 2070: "pt-PT", 2057: "en-GB", 1033: "en-US"}


def from_lcid(c: Column) -> Column:
    whole = F.create_map(*[F.lit(x) for k, v in WHOLE.items() for x in (k, v)])
    primary = F.create_map(*[F.lit(x) for k, v in PRIMARY.items() for x in (k, v)])
    c = c.cast("int")
    return F.coalesce(F.element_at(whole, c), F.element_at(primary, c.bitwiseAND(1023)))


def exact_or_folded(entries: DataFrame, word: str) -> DataFrame:
    """Entries spelled as typed; only a dictionary without any answers with those that fold alike."""
    rows = entries.filter(F.col("fold_w") == fo.fold_text(word)).withColumn("raw", F.col("w") == word)
    own = Window.partitionBy("dict_id")
    return rows.withColumn("any_raw", F.max("raw").over(own)).filter(F.col("raw") | ~F.col("any_raw")).select("dict_id", "id", "w")


def prefix_or_folded(entries: DataFrame, word: str, n: int) -> DataFrame:
    """Exact entries, then the prefix as typed in file order; folded only where that is empty; n a dictionary."""
    folded = fo.fold_text(word)
    rows = entries.filter(F.col("fold_w").startswith(folded)).withColumn("raw", F.col("w").startswith(word)).withColumn("first", ((F.col("w") != word) & (F.col("fold_w") != folded)).cast("int"))
    own = Window.partitionBy("dict_id")
    kept = rows.withColumn("any_raw", F.max("raw").over(own)).filter(F.col("raw") | ~F.col("any_raw") | (F.col("first") == 0))
    place = Window.partitionBy("dict_id").orderBy("first", "id")
    return kept.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= n).select("dict_id", "rank", "id", "w")


def _cut(frame: DataFrame) -> DataFrame:
    """The rows without their lineage, in ``spark.checkpoint.dir``; where that is unset and all runs in one process (tests), in a folder of our own."""
    spark = frame.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not found:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="lexiquarry-")
        spark.sparkContext.setCheckpointDir(found)
    return frame.checkpoint()


def named(entries: DataFrame, links: DataFrame) -> DataFrame:
    """The links, each target in the spelling of the entry or link that it means: the same, else the least that is the same but for case."""
    names = entries.select("dict_id", "w").union(links.select("dict_id", "w")).distinct()
    same = names.select(F.col("dict_id").alias("_d"), F.col("w").alias("_w"))
    loose = names.groupBy(F.col("dict_id").alias("_e"), fo.lower1("w").alias("_l")).agg(F.min("w").alias("_near"))
    rows = links.join(same, (F.col("dict_id") == F.col("_d")) & (F.col("target") == F.col("_w")), "left")
    rows = rows.join(loose, (F.col("dict_id") == F.col("_e")) & F.col("_w").isNull() & (fo.lower1("target") == F.col("_l")), "left")
    return rows.select("dict_id", "w", F.coalesce("_w", "_near", "target").alias("target"))


def follow(entries: DataFrame, links: DataFrame) -> DataFrame:
    """Every word with the entries that its chain of redirects ends at; homographs fan out, circles end in nothing (id null).

    links: dict_id, w, target. A target without an entry or link of its spelling is looked up without case. Chains of any length are
    followed, a step a round, until no word reaches a new target."""
    links = _cut(named(entries, links))
    step = links.select(F.col("dict_id").alias("_d"), F.col("w").alias("_w"), F.col("target").alias("_t"))
    parts = max(1, int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    new = reached = _cut(links.select("dict_id", "w", F.col("target").alias("at")).filter(F.col("at").isNotNull()).distinct())
    while not new.isEmpty():
        ahead = new.join(step, (F.col("dict_id") == F.col("_d")) & (F.col("at") == F.col("_w"))).select("dict_id", "w", F.col("_t").alias("at"))
        new = _cut(ahead.filter(F.col("at").isNotNull()).distinct().join(reached, ["dict_id", "w", "at"], "left_anti"))
        reached = _cut(reached.union(new).coalesce(parts))
    found = reached.join(entries.select("dict_id", F.col("w").alias("at"), "id"), ["dict_id", "at"]).select("dict_id", "w", "id").distinct()
    return links.select("dict_id", "w").distinct().join(found, ["dict_id", "w"], "left")


def path_variants(word: Column) -> Column:
    """Spellings of a title in an archive: as typed, with underscores, with a capital, with capital words."""
    under = F.replace(word, F.lit(" "), F.lit("_"))
    upper = F.concat(F.upper(F.substring(under, 1, 1)), F.expr("substring(replace(word, ' ', '_'), 2)"))
    title = F.replace(F.initcap(word), F.lit(" "), F.lit("_"))
    return F.array_distinct(F.array(word, under, upper, title))


def lemma_lines(text: DataFrame, lang: str) -> DataFrame:
    """lang, form and lemma of a lemma file: the lemma first, then its forms, tab-separated; short lines are dropped."""
    fields = F.filter(F.transform(F.split(fo.lower1(F.regexp_replace("value", "^﻿|\r$", "")), "\t"), lambda x: F.trim(x)), lambda x: x != "")
    rows = text.select(fields.alias("f")).filter(F.size("f") >= 2)
    return rows.select(F.lit(lang).alias("lang"), F.explode(F.slice("f", 2, 1 << 20)).alias("form"), F.element_at("f", 1).alias("lemma")).filter("form <> lemma").distinct()


def lemmas_of(words: DataFrame, lemma: DataFrame) -> DataFrame:
    """The lemma of each word (lang, word): by its lower-cased form; in Russian also with one е read as ё, up to three of them."""
    low = fo.lower1(F.trim("word"))
    rows = words.select("lang", "word", low.alias("form"))
    tries = F.array("form")
    for k in (1, 2, 3):
        parts = F.split("form", "е")
        own = F.concat(F.concat_ws("е", F.slice(parts, 1, k)), F.lit("ё"), F.concat_ws("е", F.slice(parts, k + 1, F.greatest(F.size(parts) - k, F.lit(0)))))
        tries = F.when((F.col("lang") == "ru") & (F.size(parts) > k) & (F.size(parts) <= 4), F.concat(tries, F.array(own))).otherwise(tries)
    asked = rows.select("lang", "word", F.posexplode(tries).alias("k", "form"))
    found = asked.join(lemma, ["lang", "form"]).filter(F.col("lemma") != fo.lower1(F.trim("word")))
    best = Window.partitionBy("lang", "word").orderBy("k", "lemma")
    return found.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("lang", "word", "lemma")


#: Words that an English index leaves out.
STOP = "a about an and are as at be by en for from how i in is it of on or that the this to was what when where which who why will with".split()


def analysed(text: Column) -> Column:
    """Index terms: folded words of letters and digits (an apostrophe or point inside, up to three + or # at the
    end), stop words and words over 64 bytes left out. Stemming needs word lists that are not here."""
    words = F.regexp_extract_all(fo.fold(text), F.lit(r"[\p{L}\p{N}]+(?:['&·.,](?=[\p{L}\p{N}])[\p{L}\p{N}]+)*[+#]{0,3}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP) & (F.octet_length(w) <= 64))


def stale(rows: DataFrame, current: dict[str, str]) -> DataFrame:
    """Why a prepared dictionary is out of date, by what it was made with."""
    reasons = [F.when(F.col(k) != v, F.lit(k)) for k, v in current.items()]
    return rows.select("dict_id", F.concat_ws(",", F.array_compact(F.array(*reasons))).alias("reasons"))


def companions(files: DataFrame) -> DataFrame:
    """Each main file with the companion files of its stem. files: stem, name and kind."""
    m = files.filter("kind = 'main'").select("stem", F.col("name").alias("main"))
    c = files.filter("kind = 'companion'").groupBy("stem").agg(F.concat_ws("|", F.sort_array(F.collect_list("name"))).alias("companions"))
    return m.join(c, "stem", "left").select("main", F.coalesce("companions", F.lit("")).alias("companions"))


def list_tag(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One validator of a list whatever its order: a digest of the sum of row digests."""
    own = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.md5(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.sum(own).cast("string"))).alias("tag"))


def by_priority(parts: list[DataFrame]) -> DataFrame:
    """The first part of a ladder of look-ups that answers a name."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy("asked").orderBy("_p", "name")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_p", "_k")


def resource_ladder(asked: DataFrame, resources: DataFrame) -> DataFrame:
    """A resource by its name as asked, else by its name without case."""
    a, r = asked.select("asked"), resources.select("name", "seq")
    same = a.join(r, a["asked"] == r["name"]).select("asked", "name", "seq")
    loose = a.join(r, fo.nocase(a["asked"]) == fo.nocase(r["name"])).select("asked", "name", "seq")
    return by_priority([same, loose])


def to_markdown(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entries as second-level headings, aliases as headings before the body: one text a dictionary entry, in id order."""
    alts = aliases.groupBy(F.col("dict_id").alias("_d"), F.col("entry_id").alias("_e")).agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("row", "w"))), lambda x: F.concat(F.lit("## "), x["w"]))).alias("alts"))
    rows = entries.join(alts, (F.col("dict_id") == F.col("_d")) & (F.col("id") == F.col("_e")), "left")
    return rows.select("dict_id", "id", F.concat_ws("\n", F.concat(F.lit("## "), "w"), "alts", "body", F.lit("")).alias("text"))
