"""Alphabetical browsing: pages, places, jumps, the alphabet strip and its chips.

Order is ASCII-case-insensitive bytes, then id; sub-entries are hidden. A place in a dictionary is the count of
the smaller two-letter heads plus a place among the words of one head, so no task sorts a whole dictionary; the
alphabet strip is made of counts by first letter alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions.fold import fold, fold_text, nocase_text, upper1
from lexiquarry.functions.numbering import numbered
from lexiquarry.operators.headword import is_sub, search
from lexiquarry.operators.pattern import Pattern

#: The leading consonants of Hangul syllables, in code order.
JAMO = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
CUT_LEAST, CUT_SHARE, PAGE_ROWS = 3000, 32, 300


def visible(entries: DataFrame) -> DataFrame:
    return entries.filter(~is_sub())


def positioned(rows: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    """The rows with pos, their place in browse order."""
    return numbered(rows, "dict_id", F.substring("nocase_w", 1, 2), ["nocase_w", "id"], "pos", start, stop)


def page(entries: DataFrame, offset: int, n: int) -> DataFrame:
    """Rows offset to offset + n of each dictionary; a word equal to the one before it in the slice is left out."""
    rows = positioned(visible(entries).select("dict_id", "id", "w", "nocase_w"), offset, offset + n)
    rows = rows.withColumn("before", F.lag("w").over(Window.partitionBy("dict_id").orderBy("pos")))
    return rows.filter(F.col("before").isNull() | (F.col("before") != F.col("w"))).select("dict_id", "pos", "id", "w")


def locate(entries: DataFrame, word: str) -> DataFrame:
    """The place of a word in each dictionary: how many visible headwords sort before it."""
    return visible(entries).groupBy("dict_id").agg(F.count_if(F.col("nocase_w") < nocase_text(word)).alias("offset"))


def jump(entries: DataFrame, word: str) -> DataFrame:
    """Where a typed word lands: offset, word and match (exact, prefix or none) in each dictionary."""
    word = word.strip()
    own = nocase_text(word)
    shown = visible(entries)
    first = search(entries, None, Pattern.literal(word, prefix=True), 1).select(F.col("dict_id").alias("d1"), F.col("key").alias("hit"))
    nexts = shown.filter(F.col("nocase_w") >= own).groupBy(F.col("dict_id").alias("d2")).agg(F.min(F.struct("nocase_w", "id", "w")).alias("n")).select("d2", F.col("n.w").alias("next"), F.col("n.nocase_w").alias("next_key"))
    hit_key = F.translate("hit", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = shown.join(first.withColumn("hit_key", hit_key), F.col("dict_id") == F.col("d1"), "left")
    counts = keyed.groupBy("dict_id").agg(F.first("hit").alias("hit"), F.count_if(F.col("nocase_w") < own).alias("own"), F.count_if(F.col("nocase_w") < F.col("hit_key")).alias("at_hit"))
    rows = counts.join(nexts, F.col("dict_id") == F.col("d2"), "left")
    exact = F.coalesce(fold("hit") == fold_text(word), F.lit(False))
    starts = F.coalesce(F.lower("next_key").startswith(own), F.lit(False))
    case = F.when(exact, F.struct(F.col("at_hit").alias("offset"), F.col("hit").alias("word"), F.lit("exact").alias("match")))
    case = case.when(starts, F.struct(F.col("own").alias("offset"), F.col("next").alias("word"), F.lit("prefix").alias("match")))
    case = case.when(F.col("hit").isNotNull(), F.struct(F.col("at_hit").alias("offset"), F.col("hit").alias("word"), F.lit("prefix").alias("match")))
    case = case.otherwise(F.struct(F.col("own").alias("offset"), F.col("next").alias("word"), F.lit("none").alias("match")))
    return rows.select("dict_id", case.alias("r")).select("dict_id", "r.*")


def initial(w: Column) -> Column:
    """The strip label of a headword: a Hangul lead, 0-9, one sign for Han and each kana, # or a folded capital."""
    first = F.substring(w, 1, 1)
    # Two of the three bytes of a syllable's UTF-8 form are enough with the third: its code point.
    byte = lambda k: F.conv(F.substring(F.hex(F.encode(first, "UTF-8")), 2 * k + 1, 2), 16, 10).cast("int")
    code = (byte(0) - 0xE0) * 4096 + (byte(1) - 0x80) * 64 + byte(2) - 0x80
    lead = F.element_at(F.split(F.lit(" ".join(JAMO)), " "), (F.floor((code - 0xAC00) / 588) + 1).cast("int"))
    folded = fold(first)
    return (
        F.when(first.rlike("^[가-힣]"), lead)
        .when(first.rlike(r"^\p{Nd}"), "0-9")
        .when(first.rlike(r"^\p{IsHan}"), "漢")
        .when(first.rlike(r"^\p{IsHiragana}"), "あ")
        .when(first.rlike(r"^\p{IsKatakana}"), "ア")
        .when(~first.rlike(r"^\p{L}"), "#")
        .otherwise(upper1(F.when(folded == "", first).otherwise(folded)))
    )


def runs(entries: DataFrame) -> DataFrame:
    """dict_id, run, label, offset and count of the stretches of equal initials in browse order, from counts by first letter."""
    letters = visible(entries).groupBy("dict_id", F.substring("nocase_w", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("dict_id").orderBy("letter")
    rows = letters.withColumn("label", initial(F.col("letter")))
    rows = rows.withColumn("start", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("new", F.when(F.lag("label").over(order) == F.col("label"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("dict_id", "run").agg(F.first("label").alias("label"), F.min("start").alias("offset"), F.sum("n").alias("count"))


def alphabet(entries: DataFrame) -> DataFrame:
    """One chip a label: runs of a label add up and the first one gives the offset."""
    return runs(entries).groupBy("dict_id", "label").agg(F.min("offset").alias("offset"), F.sum("count").alias("count"))


def chips(entries: DataFrame, least: int = CUT_LEAST, share: int = CUT_SHARE) -> DataFrame:
    """Runs longer than max(least, total / share) cut into pieces of that length: run, piece, offset, count and first word."""
    found = runs(entries)
    total = F.sum("count").over(Window.partitionBy("dict_id"))
    cut = F.greatest(F.lit(least), F.floor(total / share)).cast("long")
    pieces = found.withColumn("cut", cut).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("count") - 1) / F.col("cut")))))
    start = F.col("offset") + F.col("piece") * F.col("cut")
    length = F.least(F.col("cut"), F.col("count") - F.col("piece") * F.col("cut"))
    pieces = pieces.select(F.col("dict_id").alias("_d"), "run", "label", "piece", start.alias("offset"), length.alias("count"))
    rows = positioned(visible(entries).select("dict_id", "id", "w", "nocase_w"))
    return pieces.join(rows, (F.col("_d") == F.col("dict_id")) & (F.col("offset") == F.col("pos"))).select("dict_id", "run", "label", "piece", "offset", "count", F.col("w").alias("first_word"))


def response(total: int, offset: int, size: int = PAGE_ROWS) -> tuple[int, int]:
    """The page grid of a browse request: the start of the page that holds an offset, clamped to the last page."""
    last = max(0, (total - 1) // size * size)
    start = min(max(0, offset) // size * size, last)
    return start, min(size, max(0, total - start))
