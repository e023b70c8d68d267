"""Headword search over all dictionaries in one plan: exact, prefix, wildcard, and their key lists.

Keys are filtered on materialised folded columns (a literal head is a prefix test that reaches
the scan), ranked by class and dictionary collation, reduced to each entry's best key, cut to the top n
of each dictionary by a window that Spark limits before its shuffle, and only then joined to bodies."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions.fold import nocase_text, quoted
from lexiquarry.functions.numbering import numbered
from lexiquarry.operators.pattern import CASELESS, FOLDED, TYPED, Pattern, Rule

KEYS = {TYPED: "w", CASELESS: "lower_w", FOLDED: "fold_w"}
MOST = 500
ORDER = ["class", "fold_w", "lower_w", "cap_w", "w", "is_alias", "row"]


def clamp(n: int) -> int:
    return n if 0 < n <= MOST else MOST


def _test(rule: Rule) -> Column:
    key = F.col(KEYS[rule.reading])
    if rule.kind == "equal":
        return key == rule.value
    return key.startswith(rule.value) if rule.kind == "prefix" else key.rlike(rule.value)


def is_sub() -> Column:
    return F.col("w").like("@_%")


@dataclass(frozen=True)
class Asked:
    """One query of a plan. gate: the typed head that an alias has to equal (or, for a prefix, start with) but
    for ASCII case; without one, aliases don't answer."""

    label: str
    pattern: Pattern
    gate: str | None = None


def _class(pattern: Pattern) -> Column:
    rules = pattern.rules()
    return reduce(lambda c, r: c.when(_test(r), r.rank), rules[1:], F.when(_test(rules[0]), rules[0].rank))


def _answers(keys: DataFrame, asked: list[Asked], is_alias: bool) -> DataFrame:
    """The keys that match with q and class, a row for each query that they answer: one scan for all queries."""
    tests, hits = [], []
    for a in asked:
        own = _class(a.pattern)
        if is_alias:
            gate = nocase_text(a.gate)
            spelled = [r.rank for r in a.pattern.rules() if r.spelled]
            test = F.col("nocase_w").startswith(gate)
            own = F.when((F.col("nocase_w") == gate) | ~own.isin(spelled), own)
        else:
            head = a.pattern.head()
            test = F.col("fold_w").startswith(head) if head else F.lit(True)
        tests.append(test)
        hits.append(F.when(test & own.isNotNull(), F.struct(F.lit(a.label).alias("q"), own.alias("class"))))
    rows = keys.filter(reduce(lambda x, y: x | y, tests))
    return rows.withColumn("_h", F.explode(F.array_compact(F.array(*hits)))).select("*", "_h.q", "_h.class").drop("_h")


def search_many(entries: DataFrame, aliases: DataFrame | None, asked: list[Asked], n: int, subs: bool = False) -> DataFrame:
    """q, dict_id, rank, id, key and class of the n best entries of each dictionary for every query, in one plan.

    entries and aliases carry the keys of ``views.keyed``."""
    e = entries if subs else entries.filter(~is_sub())
    rows = _answers(e.select("dict_id", "id", F.lit(0).alias("is_alias"), F.col("id").alias("row"), "w", "fold_w", "lower_w", "cap_w"), asked, False)
    gated = [a for a in asked if a.gate]
    if aliases is not None and gated:
        a = aliases.select("dict_id", F.col("entry_id").alias("id"), F.lit(1).alias("is_alias"), "row", "w", "fold_w", "lower_w", "cap_w", "nocase_w")
        rows = rows.unionByName(_answers(a, gated, True).drop("nocase_w"))
    best = Window.partitionBy("q", "dict_id", "id").orderBy(*ORDER)
    once = rows.withColumn("_k", F.row_number().over(best)).filter("_k = 1")
    top = Window.partitionBy("q", "dict_id").orderBy(*ORDER, "id")
    out = once.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= clamp(n))
    return out.select("q", "dict_id", "rank", "id", F.col("w").alias("key"), "class")


def search(entries: DataFrame, aliases: DataFrame | None, pattern: Pattern, n: int, subs: bool = False, gate: str | None = None) -> DataFrame:
    """dict_id, rank, id, key and class of the n best entries of each dictionary."""
    return search_many(entries, aliases, [Asked("", pattern, gate)], n, subs).drop("q")


def exact(entries: DataFrame, aliases: DataFrame | None, word: str, n: int = 20) -> DataFrame:
    word = word.strip()
    return search(entries, aliases, Pattern.literal(word), n, subs=True, gate=word)


def prefix(entries: DataFrame, aliases: DataFrame | None, word: str, n: int = 20) -> DataFrame:
    word = word.strip()
    return search(entries, aliases, Pattern.literal(word, prefix=True), n, gate=word)


def wildcard(entries: DataFrame, text: str, n: int = 20) -> DataFrame:
    return search(entries, None, Pattern.wildcard(text.strip()), n)


def with_headword(hits: DataFrame, entries: DataFrame, *columns: str) -> DataFrame:
    """The headword (and other columns) of ranked hits, joined after the cut; hits are at most n a dictionary."""
    e = entries.select(F.col("dict_id").alias("_d"), F.col("id").alias("_i"), F.col("w").alias("headword"), *columns)
    return hits.join(e, (F.col("dict_id") == F.col("_d")) & (F.col("id") == F.col("_i")), "left").drop("_d", "_i")


def keywords(entries: DataFrame, offset: int, n: int) -> DataFrame:
    """A slice of the visible headwords of each dictionary in id order."""
    rows = numbered(entries.filter(~is_sub()), "dict_id", F.floor(F.col("id") / 65536), ["id"], "pos", offset, offset + n if n > 0 else None)
    return rows.select("dict_id", "pos", "id", "w")


def has(entries: DataFrame, aliases: DataFrame, words: DataFrame) -> DataFrame:
    """dict_id and word of every asked word that a dictionary lists but for case and accents."""
    keys = entries.filter(~is_sub()).select("dict_id", "fold_w").union(aliases.select("dict_id", "fold_w")).distinct()
    return words.join(keys, words["fold_q"] == keys["fold_w"]).select("dict_id", "word").distinct()


# SQL twins, for the oracles.


def _test_sql(rule: Rule) -> str:
    key, value = KEYS[rule.reading], quoted(rule.value)
    return {"equal": f"{key} = {value}", "prefix": f"starts_with({key}, {value})", "regex": f"regexp_matches({key}, {value})"}[rule.kind]


def search_sql(pattern: Pattern, n: int, subs: bool, gate: str | None, entries: str = "ek", aliases: str = "ak") -> str:
    rules = pattern.rules()
    cases = "CASE " + " ".join(f"WHEN {_test_sql(r)} THEN {r.rank}" for r in rules) + " END"
    spelled = ",".join(str(r.rank) for r in rules if r.spelled) or "-1"
    sub = "" if subs else "WHERE NOT w LIKE '@_%'"
    rows = f"SELECT dict_id, id, 0 AS is_alias, id AS row, w, fold_w, lower_w, cap_w, nocase_w, {cases} AS class FROM {entries} {sub}"
    if gate:
        own = quoted(nocase_text(gate))
        rows += f" UNION ALL SELECT * FROM (SELECT dict_id, entry_id AS id, 1 AS is_alias, row, w, fold_w, lower_w, cap_w, nocase_w, {cases} AS class FROM {aliases}) WHERE (class IN ({spelled}) AND nocase_w = {own}) OR (class NOT IN ({spelled}) AND starts_with(nocase_w, {own}))"
    order = ", ".join(ORDER)
    return f"""SELECT dict_id, rank::INTEGER AS rank, id, w AS key, class::INTEGER AS class FROM (
  SELECT *, row_number() OVER (PARTITION BY dict_id ORDER BY {order}, id) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY dict_id, id ORDER BY {order}) AS k FROM ({rows}) WHERE class IS NOT NULL) WHERE k = 1)
WHERE rank <= {clamp(n)}"""
