"""Registered headword, browse, fan-out and suggestion queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiquarry.functions import fold as fo
from lexiquarry.functions.numbering import numbered
from lexiquarry.operators import browse, headword
from lexiquarry.operators.pattern import Pattern
from lexiquarry.operators.suggest import suggested
from lexiquarry.plans import views

N = 20
PREFIXES = ("Én", "él", "the", "The", "ü", "A", "zz")
EXACTS = ("the", "The", "LE", "über")
WILDCARDS = ("*tion", "?n", "É*", "a*e", "th?")


def _keys(spark, d):
    return views.store(spark, d)


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def h1_exact(spark, d):
    e, a = _keys(spark, d)
    return headword.search_many(e, a, [headword.Asked(q, Pattern.literal(q), q) for q in EXACTS], N, subs=True)


def h2_prefix_topn(spark, d):
    e, a = _keys(spark, d)
    return headword.search_many(e, a, [headword.Asked(q, Pattern.literal(q, prefix=True), q) for q in PREFIXES], N)


def h3_wildcard(spark, d):
    e, _ = _keys(spark, d)
    return headword.search_many(e, None, [headword.Asked(q, Pattern.wildcard(q)) for q in WILDCARDS], N)


def h4_prefix_keys(spark, d):
    e, a = _keys(spark, d)
    return headword.prefix(e, a, "en", 50).select("dict_id", "rank", "key")


def h9_hits_with_headword(spark, d):
    e, a = _keys(spark, d)
    return headword.with_headword(headword.prefix(e, a, "Th", N), e)


def h10_collation_order(spark, d):
    rows = views.keyed(views.table(spark, d, "documents", "lang", "text").select(F.col("lang").alias("dict_id"), F.explode(F.regexp_extract_all("text", F.lit(views.WORD), F.lit(0))).alias("w")).distinct())
    placed = numbered(rows, "dict_id", F.substring("fold_w", 1, 2), ["fold_w", "lower_w", "cap_w", "w"], "pos")
    return placed.select("dict_id", "w", (F.col("pos") + 1).alias("place"))


def h13_keywords(spark, d):
    return headword.keywords(views.entry(spark, d), 100, 50)


def h14_has(spark, d):
    e, a = _keys(spark, d)
    words = views.table(spark, d, "benchmark", "item_id", "text").select(F.explode(F.regexp_extract_all("text", F.lit(views.WORD), F.lit(0))).alias("word")).distinct()
    return headword.has(e, a, words.withColumn("fold_q", fo.fold("word")))


def s2_entry_aliases(spark, d):
    e, a = views.entry(spark, d), views.alias(spark, d)
    own = a.groupBy(F.col("dict_id").alias("_d"), F.col("entry_id").alias("_e")).agg(F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("row", "w"))), lambda x: x["w"])).alias("aliases"))
    return e.join(own, (F.col("dict_id") == F.col("_d")) & (F.col("id") == F.col("_e")), "left").select("dict_id", "id", "w", F.coalesce("aliases", F.lit("")).alias("aliases"))


def x1_fanout_slots(spark, d):
    """Every dictionary answers in its slot, also with nothing: status, hits and the best key."""
    e, a = _keys(spark, d)
    hits = headword.prefix(e, a, "Én", N).groupBy(F.col("dict_id").alias("_d")).agg(F.count(F.lit(1)).alias("hits"), F.min_by("key", "rank").alias("best"))
    slots = views.table(spark, d, "documents", "lang").select(F.col("lang").alias("dict_id")).distinct()
    out = slots.join(hits, F.col("dict_id") == F.col("_d"), "left")
    return out.select("dict_id", F.when(F.col("hits").isNull(), "empty").otherwise("ok").alias("status"), F.coalesce("hits", F.lit(0)).alias("hits"), "best")


def x3_scope_order(spark, d):
    """A list of dictionaries keeps its order; unknown ids are dropped."""
    e, a = _keys(spark, d)
    scope = spark.createDataFrame([(i, x) for i, x in enumerate(["fr", "xx", "en"])], "slot int, scope_id string")
    return headword.prefix(e, a, "le", 5).join(F.broadcast(scope), F.col("dict_id") == F.col("scope_id")).select("slot", "dict_id", "rank", "key")


def x5_suggest_merge(spark, d):
    e, a = _keys(spark, d)
    q = "the"
    return suggested(headword.prefix(e, a, q, N), q, N)


def b1_page(spark, d):
    return browse.page(views.store(spark, d)[0], 300, browse.PAGE_ROWS)


def b2_locate(spark, d):
    e = views.store(spark, d)[0]
    return _union([browse.locate(e, q).withColumn("q", F.lit(q)) for q in ("en", "Le", "über", "zz")])


def b3_jump(spark, d):
    e = views.store(spark, d)[0]
    return _union([browse.jump(e, q).withColumn("q", F.lit(q)) for q in ("en", "LE", "él", "qqq", "thzz")])


def b4_alphabet(spark, d):
    return browse.alphabet(views.store(spark, d)[0])


def b5_chips(spark, d):
    return browse.chips(views.store(spark, d)[0], 500, 32)


def x11_word_shape(spark, d):
    """Counts of words by shape and case habit in each dictionary."""
    t = views.tokens(spark, d)
    letters, upper = F.regexp_count("w", F.lit(r"\p{L}")), F.regexp_count("w", F.lit(fo.CAPITAL))
    lower = F.regexp_count("w", F.lit(r"\p{Ll}"))
    shape = (letters >= 4) & (letters <= 18) & ~F.col("w").rlike(r"^\p{M}")
    case = F.when((upper == 0) & (lower == 0), "none").when(upper == 0, "lower").when(lower == 0, "caps").when((upper == 1) & F.col("w").rlike("^" + fo.CAPITAL), "title").otherwise("mixed")
    return t.groupBy("dict_id", shape.alias("word_shape"), case.alias("word_case")).agg(F.count(F.lit(1)).alias("n"))


def x13_case_habit(spark, d):
    t = views.tokens(spark, d)
    upper, lower = F.regexp_count("w", F.lit(fo.CAPITAL)), F.regexp_count("w", F.lit(r"\p{Ll}"))
    case = F.when(upper == 0, "lower").when(lower == 0, "caps").when((upper == 1) & F.col("w").rlike("^" + fo.CAPITAL), "title").otherwise("mixed")
    counts = t.groupBy("dict_id", case.alias("habit")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("dict_id").orderBy(F.desc("n"), "habit")
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select("dict_id", "habit", "n")


#: Languages whose words lose a plural ending alone; English loses those of verbs too.
PLURALS = ("ca", "es", "fr", "it", "pt", "ro")


def stems(w: str, lang: str) -> Column:
    """What a word of small letters may be a form of, by its ending, in the language of a column; a doubled last letter also goes."""

    def cut(n: int, then: str = "") -> list:
        stem = F.expr(f"left({w}, char_length({w}) - {n})")
        if then:
            return [F.concat(stem, F.lit(then))]
        last, before = F.right(stem, F.lit(1)), F.substring(stem, -2, 1)
        return [stem, F.when((F.char_length(stem) >= 2) & (last == before), F.expr(f"left({w}, char_length({w}) - {n + 1})"))]

    c, language = F.col(w), F.col(lang)
    plain = ~c.endswith("ss") & ~c.endswith("us") & ~c.endswith("is")
    plural = F.when(c.endswith("es"), F.array(*cut(2), *cut(1))).when(c.endswith("s") & plain, F.array(*cut(1)))
    verb = F.when(c.endswith("ies") | c.endswith("ied"), F.array(*cut(3, "y"))).when(c.endswith("ed"), F.array(*cut(2), *cut(1))).when(c.endswith("ing"), F.array(*cut(3), *cut(3, "e")))
    found = F.when(language == "en", F.coalesce(verb, plural)).when(language.isin(*PLURALS), plural)
    return F.filter(F.array_distinct(F.array_compact(found)), lambda s: F.char_length(s) >= 3)


def x12_stems(spark, d):
    """Words of which a stem is an entry of the same dictionary too."""
    words = views.tokens(spark, d).filter(~F.col("w").rlike(fo.CAPITAL) & F.col("w").rlike(r"\p{Ll}"))
    rows = words.select("dict_id", "w", F.explode(stems("w", "dict_id")).alias("stem"))
    known = words.select(F.col("dict_id").alias("_d"), F.col("w").alias("_w"))
    return rows.join(known, (F.col("dict_id") == F.col("_d")) & (F.col("stem") == F.col("_w")), "left_semi").select("dict_id", "w", "stem")


def x10_random_word(spark, d):
    """A fixed draw from each dictionary: of the words of the right shape and of small letters the one with the least hash, forms of
    other words of the dictionary only where it has nothing else."""
    t = views.tokens(spark, d).filter((F.char_length("w") >= 4) & (F.char_length("w") <= 18) & ~F.col("w").rlike(fo.CAPITAL))
    forms = x12_stems(spark, d).select(F.col("dict_id").alias("_d"), F.col("w").alias("_w")).distinct()
    vetted = t.join(forms, (F.col("dict_id") == F.col("_d")) & (F.col("w") == F.col("_w")), "left")
    place = F.struct(F.col("_w").isNotNull().cast("int").alias("form"), F.md5(F.concat_ws("#", F.lit("seed-1"), "w")).alias("h"), "w")
    return vetted.groupBy("dict_id").agg(F.min(place).alias("m")).select("dict_id", F.col("m.w").alias("w"))


#: Own lemma rows (lang, form, lemma), as a lemma file would give them.
LEMMAS = [("en", "ones", "one"), ("en", "theses", "these"), ("en", "zzthes", "the"), ("fr", "zzthes", "la"), ("de", "zzthes", "zzthes"), ("es", "zzthes", "los")]


def x6_lemma_wave(spark, d):
    """Dictionaries without an answer are asked again for the lemma of the word in their language."""
    e, a = _keys(spark, d)
    q = "zzthes"
    first = headword.exact(e, a, q, N)
    lemma = spark.createDataFrame(LEMMAS, "lang string, form string, lemma string").filter((F.col("form") == q) & (F.col("lemma") != q))
    missed = views.table(spark, d, "documents", "lang").distinct().join(first.select(F.col("dict_id").alias("_d")).distinct(), F.col("lang") == F.col("_d"), "left_anti")
    asked = missed.join(F.broadcast(lemma), "lang").select("lang", "lemma", fo.fold("lemma").alias("f"))
    rows = e.join(F.broadcast(asked), (F.col("dict_id") == F.col("lang")) & (F.col("fold_w") == F.col("f")))
    w = Window.partitionBy("dict_id").orderBy((F.col("w") != F.col("lemma")).cast("int"), "lower_w", "cap_w", "w", "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= N).select("dict_id", "rank", F.lit(q).alias("from_word"), F.col("lemma").alias("to_word"), F.col("w").alias("key"))


QUERIES = {f.__name__: f for f in (h1_exact, h2_prefix_topn, h3_wildcard, h4_prefix_keys, h9_hits_with_headword, h10_collation_order, h13_keywords, h14_has, s2_entry_aliases, x1_fanout_slots, x3_scope_order, x5_suggest_merge, b1_page, b2_locate, b3_jump, b4_alphabet, b5_chips, x6_lemma_wave, x10_random_word, x11_word_shape, x12_stems, x13_case_habit)}

_WITH = f"WITH {views.HEAD_SQL}, ek AS MATERIALIZED ({views.keyed_sql('entry')}), ak AS MATERIALIZED ({views.keyed_sql('alias')})"
_LIT = lambda q: fo.quoted(q) + " AS q"


def _searches(queries, make):
    return _WITH + " " + " UNION ALL ".join(f"SELECT *, {_LIT(q)} FROM ({make(q)})" for q in queries)


def _exact_sql(q, n=N):
    return headword.search_sql(Pattern.literal(q), n, True, q)


def _prefix_sql(q, n=N):
    return headword.search_sql(Pattern.literal(q, prefix=True), n, False, q)


_SHOWN = "shown AS (SELECT * FROM ek WHERE NOT w LIKE '@_%')"
_LETTER = "\\p{L}"
_FIRST = fo.translate_sql("substr(w, 1, 1)", "fold")
_INITIAL = f"""CASE WHEN regexp_matches(w, '^[가-힣]') THEN '가' WHEN regexp_matches(w, '^\\p{{Nd}}') THEN '0-9' WHEN regexp_matches(w, '^\\p{{Han}}') THEN '漢'
  WHEN regexp_matches(w, '^\\p{{Hiragana}}') THEN 'あ' WHEN regexp_matches(w, '^\\p{{Katakana}}') THEN 'ア' WHEN NOT regexp_matches(w, '^\\p{{L}}') THEN '#'
  ELSE {fo.translate_sql("CASE WHEN " + _FIRST + " = '' THEN substr(w, 1, 1) ELSE " + _FIRST + " END", "upper")} END"""


def _jump_sql(q):
    own = fo.quoted(fo.nocase_text(q))
    return f"""SELECT dict_id, (r).offset_ AS "offset", (r).word AS word, (r).match_ AS "match" FROM (
  SELECT c.dict_id, CASE WHEN coalesce({fo.translate_sql("hit", "fold")} = {fo.quoted(fo.fold_text(q))}, false) THEN {{'offset_': at_hit, 'word': hit, 'match_': 'exact'}}
    WHEN coalesce(starts_with(lower(next_key), {own}), false) THEN {{'offset_': own, 'word': next_, 'match_': 'prefix'}}
    WHEN hit IS NOT NULL THEN {{'offset_': at_hit, 'word': hit, 'match_': 'prefix'}} ELSE {{'offset_': own, 'word': next_, 'match_': 'none'}} END AS r
  FROM (SELECT s.dict_id, any_value(f.key) AS hit, count(*) FILTER (s.nocase_w < {own}) AS own, count(*) FILTER (s.nocase_w < {fo.translate_sql("f.key", "nocase")}) AS at_hit
    FROM shown s LEFT JOIN ({headword.search_sql(Pattern.literal(q, prefix=True), 1, False, None)}) f ON f.dict_id = s.dict_id GROUP BY s.dict_id) c
  LEFT JOIN (SELECT dict_id, arg_min(w, (nocase_w, id)) AS next_, min(nocase_w) AS next_key FROM shown WHERE nocase_w >= {own} GROUP BY dict_id) n ON n.dict_id = c.dict_id)"""


_CASE = f"""CASE WHEN up = 0 AND lo = 0 THEN 'none' WHEN up = 0 THEN 'lower' WHEN lo = 0 THEN 'caps' WHEN up = 1 AND regexp_matches(w, '^{fo.CAPITAL}') THEN 'title' ELSE 'mixed' END"""
_CASED = f"""cased AS (SELECT dict_id, w, len(regexp_extract_all(w, '\\p{{L}}')) AS letters, len(regexp_extract_all(w, '{fo.CAPITAL}')) AS up, len(regexp_extract_all(w, '\\p{{Ll}}')) AS lo FROM token)"""


def _stem_sql(n: int, then: str = "") -> str:
    s = f"left(w, len(w) - {n})"
    if then:
        return f"{s} || '{then}'"
    return f"{s}, CASE WHEN right({s}, 1) = right(left(w, len(w) - {n + 1}), 1) AND len(w) > {n + 1} THEN left(w, len(w) - {n + 1}) END"


ORACLE_SQL = {
    "h1_exact": _searches(EXACTS, _exact_sql),
    "h2_prefix_topn": _searches(PREFIXES, _prefix_sql),
    "h3_wildcard": _searches(WILDCARDS, lambda q: headword.search_sql(Pattern.wildcard(q), N, False, None)),
    "h4_prefix_keys": f"{_WITH} SELECT dict_id, rank, key FROM ({_prefix_sql('en', 50)})",
    "h9_hits_with_headword": f"{_WITH} SELECT h.*, e.w AS headword FROM ({_prefix_sql('Th')}) h LEFT JOIN ek e ON e.dict_id = h.dict_id AND e.id = h.id",
    "h10_collation_order": f"WITH {views.HEAD_SQL}, tk AS ({views.keyed_sql('token')}) SELECT dict_id, w, row_number() OVER (PARTITION BY dict_id ORDER BY fold_w, lower_w, cap_w, w) AS place FROM tk",
    "h13_keywords": f"WITH {views.HEAD_SQL} SELECT dict_id, pos, id, w FROM (SELECT dict_id, row_number() OVER (PARTITION BY dict_id ORDER BY id) - 1 AS pos, id, w FROM entry WHERE NOT w LIKE '@_%') WHERE pos >= 100 AND pos < 150",
    "h14_has": f"{_WITH} SELECT DISTINCT k.dict_id, b.word FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{views.WORD}')) AS word FROM benchmark) b JOIN (SELECT dict_id, fold_w FROM ek WHERE NOT w LIKE '@_%' UNION SELECT dict_id, fold_w FROM ak) k ON k.fold_w = {fo.translate_sql('b.word', 'fold')}",
    "s2_entry_aliases": f"WITH {views.HEAD_SQL} SELECT e.dict_id, e.id, e.w, coalesce(a.aliases, '') AS aliases FROM entry e LEFT JOIN (SELECT dict_id, entry_id, string_agg(w, '|' ORDER BY row) AS aliases FROM alias GROUP BY ALL) a ON a.dict_id = e.dict_id AND a.entry_id = e.id",
    "x1_fanout_slots": f"{_WITH} SELECT s.dict_id, CASE WHEN h.hits IS NULL THEN 'empty' ELSE 'ok' END AS status, coalesce(h.hits, 0) AS hits, h.best FROM (SELECT DISTINCT lang AS dict_id FROM documents) s LEFT JOIN (SELECT dict_id, count(*) AS hits, arg_min(key, rank) AS best FROM ({_prefix_sql('Én')}) GROUP BY dict_id) h ON h.dict_id = s.dict_id",
    "x3_scope_order": f"{_WITH} SELECT s.slot, h.dict_id, h.rank, h.key FROM ({_prefix_sql('le', 5)}) h JOIN (VALUES (0, 'fr'), (1, 'xx'), (2, 'en')) s(slot, scope_id) ON s.scope_id = h.dict_id",
    "x5_suggest_merge": f"""{_WITH}, sk AS ({views.keyed_sql("(SELECT DISTINCT trim(key) AS w FROM (" + _prefix_sql("the") + ") WHERE trim(key) <> '')")}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY lower_w ORDER BY fold_w, lower_w, cap_w, w) AS r, max(CASE WHEN w = 'the' THEN w END) OVER (PARTITION BY lower_w) AS typed FROM sk)
SELECT rank::INTEGER AS rank, coalesce(typed, w) AS word FROM (SELECT *, row_number() OVER (ORDER BY fold_w, lower_w, cap_w, w) AS rank FROM s1 WHERE r = 1) WHERE rank <= {N}""",
    "b1_page": f"{_WITH}, {_SHOWN}, p AS (SELECT dict_id, row_number() OVER (PARTITION BY dict_id ORDER BY nocase_w, id) - 1 AS pos, id, w FROM shown), s AS (SELECT *, lag(w) OVER (PARTITION BY dict_id ORDER BY pos) AS before FROM p WHERE pos >= 300 AND pos < {300 + browse.PAGE_ROWS}) SELECT dict_id, pos, id, w FROM s WHERE before IS NULL OR before <> w",
    "b2_locate": f"{_WITH}, {_SHOWN} " + " UNION ALL ".join(f"SELECT dict_id, count(*) FILTER (nocase_w < {fo.quoted(fo.nocase_text(q))}) AS \"offset\", {_LIT(q)} FROM shown GROUP BY dict_id" for q in ("en", "Le", "über", "zz")),
    "b3_jump": f"{_WITH}, {_SHOWN} " + " UNION ALL ".join(f"SELECT *, {_LIT(q)} FROM ({_jump_sql(q)})" for q in ("en", "LE", "él", "qqq", "thzz")),
    "b4_alphabet": f"{_WITH}, {_SHOWN}, i AS (SELECT dict_id, {_INITIAL} AS label, row_number() OVER (PARTITION BY dict_id ORDER BY nocase_w, id) - 1 AS pos FROM shown) SELECT dict_id, label, min(pos) AS \"offset\", count(*) AS count FROM i GROUP BY dict_id, label",
    "b5_chips": f"""{_WITH}, {_SHOWN}, i AS (SELECT dict_id, id, w, nocase_w, {_INITIAL} AS label, row_number() OVER (PARTITION BY dict_id ORDER BY nocase_w, id) - 1 AS pos, count(*) OVER (PARTITION BY dict_id) AS total FROM shown),
l AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY dict_id ORDER BY pos) = label THEN 0 ELSE 1 END AS new FROM i), r AS (SELECT *, sum(new) OVER (PARTITION BY dict_id ORDER BY pos)::BIGINT AS run FROM l),
p AS (SELECT *, (row_number() OVER (PARTITION BY dict_id, run ORDER BY pos) - 1) // greatest(500, total // 32) AS piece FROM r)
SELECT dict_id, run, any_value(label) AS label, piece, min(pos) AS "offset", count(*) AS count, arg_min(w, pos) AS first_word FROM p GROUP BY dict_id, run, piece""",
    "x6_lemma_wave": f"""{_WITH}, missed AS (SELECT DISTINCT lang FROM documents WHERE lang NOT IN (SELECT dict_id FROM ({_exact_sql("zzthes")}))),
asked AS (SELECT m.lang, l.lemma FROM missed m JOIN (VALUES {", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LEMMAS)}) l(lang, form, lemma) ON l.lang = m.lang AND form = 'zzthes' AND lemma <> 'zzthes')
SELECT dict_id, rank::INTEGER AS rank, 'zzthes' AS from_word, lemma AS to_word, w AS key FROM (
  SELECT e.dict_id, a.lemma, e.w, row_number() OVER (PARTITION BY e.dict_id ORDER BY (e.w <> a.lemma)::INTEGER, e.lower_w, e.cap_w, e.w, e.id) AS rank
  FROM ek e JOIN asked a ON a.lang = e.dict_id AND e.fold_w = {fo.translate_sql("a.lemma", "fold")}) WHERE rank <= {N}""",
    "x11_word_shape": f"WITH {views.HEAD_SQL}, {_CASED} SELECT dict_id, letters >= 4 AND letters <= 18 AND NOT regexp_matches(w, '^\\p{{M}}') AS word_shape, {_CASE} AS word_case, count(*) AS n FROM cased GROUP BY ALL",
    "x12_stems": f"""WITH {views.HEAD_SQL}, w AS (SELECT dict_id, w FROM token WHERE NOT regexp_matches(w, '{fo.CAPITAL}') AND regexp_matches(w, '\\p{{Ll}}')),
s AS (SELECT dict_id, w, unnest(list_distinct(CASE WHEN dict_id = 'en' AND (w LIKE '%ies' OR w LIKE '%ied') THEN [{_stem_sql(3, "y")}] WHEN dict_id = 'en' AND w LIKE '%ed' THEN [{_stem_sql(2)}, {_stem_sql(1)}] WHEN dict_id = 'en' AND w LIKE '%ing' THEN [{_stem_sql(3)}, {_stem_sql(3, "e")}]
  WHEN dict_id IN ('en', {", ".join(map(fo.quoted, PLURALS))}) AND w LIKE '%es' THEN [{_stem_sql(2)}, {_stem_sql(1)}] WHEN dict_id IN ('en', {", ".join(map(fo.quoted, PLURALS))}) AND w LIKE '%s' AND NOT w LIKE '%ss' AND NOT w LIKE '%us' AND NOT w LIKE '%is' THEN [{_stem_sql(1)}] END)) AS stem FROM w)
SELECT dict_id, w, stem FROM s WHERE len(stem) >= 3 AND (dict_id, stem) IN (SELECT (dict_id, w) FROM w)""",
    "x13_case_habit": f"WITH {views.HEAD_SQL}, {_CASED}, n AS (SELECT dict_id, {_CASE} AS habit, count(*) AS n FROM cased GROUP BY ALL) SELECT dict_id, habit, n FROM (SELECT *, row_number() OVER (PARTITION BY dict_id ORDER BY n DESC, habit) AS r FROM n) WHERE r = 1",
}

_STEMS = ORACLE_SQL["x12_stems"]
ORACLE_SQL["x10_random_word"] = f"""WITH forms AS MATERIALIZED (SELECT DISTINCT dict_id, w FROM ({_STEMS})), token AS (SELECT DISTINCT lang AS dict_id, unnest(regexp_extract_all(text, '{views.WORD}')) AS w FROM documents)
SELECT t.dict_id, arg_min(t.w, ((f.w IS NOT NULL)::INTEGER, md5('seed-1#' || t.w), t.w)) AS w FROM token t LEFT JOIN forms f ON f.dict_id = t.dict_id AND f.w = t.w WHERE len(t.w) BETWEEN 4 AND 18 AND NOT regexp_matches(t.w, '{fo.CAPITAL}') GROUP BY t.dict_id"""
