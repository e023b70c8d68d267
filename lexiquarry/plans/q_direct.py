"""Registered queries on unprepared dictionaries, lemmas, analysis and upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions import fold as fo
from lexiquarry.functions import text as tx
from lexiquarry.operators import direct, library
from lexiquarry.plans import q_library, views
from lexiquarry.sources import formats, readers


def _keys(spark, d):
    return views.store(spark, d)[0]


def h16_direct_exact(spark, d):
    return direct.exact_or_folded(_keys(spark, d), "the").unionByName(direct.exact_or_folded(_keys(spark, d), "LE"))


def h17_direct_prefix(spark, d):
    return direct.prefix_or_folded(_keys(spark, d), "Th", 30)


def _chains(spark, d):
    """Parts that point at the part of half their key; keys under 32 are entries, and two point at each other."""
    p = views.table(spark, d, "part", "p_partkey")
    key = F.col("p_partkey").cast("string")
    entries = p.filter("p_partkey < 32").select(F.lit("parts").alias("dict_id"), F.col("p_partkey").alias("id"), key.alias("w"))
    links = p.filter("p_partkey >= 32").select(F.lit("parts").alias("dict_id"), key.alias("w"), F.when(F.col("p_partkey") == 100, "101").when(F.col("p_partkey") == 101, "100").otherwise((F.col("p_partkey") / 2).cast("long").cast("string")).alias("target"))
    return entries, links


def h18_follow_redirects(spark, d):
    return direct.follow(*_chains(spark, d))


def h19_path_variants(spark, d):
    return views.table(spark, d, "part", "p_partkey", "p_name").withColumn("word", F.col("p_name")).select("p_partkey", F.posexplode(direct.path_variants(F.col("word"))).alias("k", "variant"))


LEMMA_FILE = ["﻿go\tgoes\tWent\tgone\r", "lone", "\t", "ёлка\tёлки\tёлку", "see\tsaw\tseen", "saw\tsaws"]


def x8_lemma_file(spark, d):
    return direct.lemma_lines(spark.createDataFrame([(x,) for x in LEMMA_FILE], "value string"), "en")


def x7_lemma_lookup(spark, d):
    lemma = direct.lemma_lines(spark.createDataFrame([(x,) for x in LEMMA_FILE], "value string"), "ru")
    words = spark.createDataFrame([("ru", w) for w in (" Went ", "елки", "Елку", "go", "saws", "nothing", "saw")], "lang string, word string")
    return direct.lemmas_of(words, lemma)


def l6_lcid(spark, d):
    return views.table(spark, d, "customer", "c_custkey").select("c_custkey", direct.from_lcid(F.col("c_custkey") + 900).alias("code"))


def f17_analyzer(spark, d):
    b = views.table(spark, d, "benchmark", "item_id", "text")
    return b.select("item_id", F.posexplode(direct.analysed(F.concat("text", F.lit(" it's c++ 3.14 the A.B")))).alias("k", "term"))


def m2_stale(spark, d):
    c = views.table(spark, d, "customer", "c_custkey", "c_nationkey")
    rows = c.select(F.col("c_custkey").alias("dict_id"), (F.col("c_nationkey") % 3).cast("string").alias("schema"), (F.col("c_custkey") % 4).cast("string").alias("reader"), F.lit("z").alias("codec"))
    return direct.stale(rows, {"schema": "2", "reader": "1", "codec": "z"})


def m5_leftovers(spark, d):
    """Orders that stayed open over a year before the newest one, as interrupted jobs."""
    o = views.table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    newest = o.agg(F.max("o_orderdate").alias("m"))
    return o.filter("o_orderstatus = 'O'").crossJoin(F.broadcast(newest)).filter(F.col("o_orderdate") < F.col("m") - F.expr("INTERVAL 365 DAY")).select("o_orderkey")


SUFFIXES = [*formats.MAIN, *formats.COMPANION, ".txt", ".zip"]


def _files(spark, d):
    p = views.table(spark, d, "part", "p_partkey", "p_name")
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("p_partkey") % len(SUFFIXES) + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), suffix)
    return p.select("p_partkey", name.alias("name"), readers._suffix_case(name, "kind").alias("kind"), readers._suffix_case(name, "format").alias("format"), readers._stem(name).alias("stem"))


def s12_classify(spark, d):
    return _files(spark, d).groupBy("kind", "format").agg(F.count(F.lit(1)).alias("n"))


def r1_companions(spark, d):
    return direct.companions(_files(spark, d).select("stem", "name", "kind").distinct())


def x15_list_tag(spark, d):
    return direct.list_tag(views.table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), ["n_nationkey", "n_name", "n_regionkey"])


def t19_resource_ladder(spark, d):
    r = q_library._resources(spark, d).select("name", "seq")
    asked = r.select(F.when(F.col("seq") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("asked")).distinct()
    return direct.resource_ladder(asked, r.groupBy("name").agg(F.min("seq").alias("seq"))).select("asked", "name", "seq")


def k9_markdown(spark, d):
    e, a, _ = library.ingest(q_library._raw(spark, d))
    return direct.to_markdown(e, a)


def s8a_article_body(spark, d):
    return views.table(spark, d, "pages", "page_id", "html").select("page_id", F.md5(F.regexp_extract("html", "(?is)<body[^>]*>(.*)</body>", 1)).alias("digest"))


def s3b_text_to_html(spark, d):
    return views.table(spark, d, "benchmark", "item_id", "text").select("item_id", tx.body_of(F.col("text"), F.lit("text")).alias("body"))


_NAMES = "h16_direct_exact h17_direct_prefix h18_follow_redirects h19_path_variants x8_lemma_file x7_lemma_lookup l6_lcid f17_analyzer m2_stale m5_leftovers s12_classify r1_companions x15_list_tag t19_resource_ladder k9_markdown s8a_article_body s3b_text_to_html".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_EK = f"WITH {views.HEAD_SQL}, ek AS MATERIALIZED ({views.keyed_sql('entry')})"


def _exact_sql(w):
    return f"SELECT dict_id, id, w FROM (SELECT *, w = '{w}' AS raw, max((w = '{w}')::INTEGER) OVER (PARTITION BY dict_id) AS any_raw FROM ek WHERE fold_w = '{fo.fold_text(w)}') WHERE raw OR any_raw = 0"


_KIND = "CASE " + " ".join(f"WHEN ends_with(lower(name), '{s}') THEN '{k}'" for s, k in sorted([*((s, "main") for s in formats.MAIN), *((s, "companion") for s in formats.COMPANION), *((s, "candidate") for s in formats.CANDIDATE)], key=lambda x: (-len(x[0]), x[0]))) + " ELSE 'other' END"
_FORM = "CASE " + " ".join(f"WHEN ends_with(lower(name), '{s}') THEN '{f}'" for s, f in sorted([*formats.MAIN.items(), *formats.COMPANION.items(), *((s, "") for s in formats.CANDIDATE)], key=lambda x: (-len(x[0]), x[0]))) + " ELSE '' END"
_STEM = "regexp_replace(name, '(?i)(?:" + "|".join(s.replace(".", "\\.") for s in sorted([*formats.MAIN, *formats.COMPANION], key=len, reverse=True)) + ")$', '')"
_FILES = f"f AS (SELECT DISTINCT p_partkey, replace(p_name, ' ', '_') || [{', '.join(fo.quoted(s) for s in SUFFIXES)}][p_partkey % {len(SUFFIXES)} + 1] AS name FROM part), k AS (SELECT *, {_KIND} AS kind, {_FORM} AS format, {_STEM} AS stem FROM f)"
_WHOLE = " ".join(f"WHEN l = {k} THEN '{v}'" for k, v in direct.WHOLE.items()) + " " + " ".join(f"WHEN l & 1023 = {k} THEN '{v}'" for k, v in direct.PRIMARY.items())

ORACLE_SQL = {
    "h16_direct_exact": f"{_EK} {_exact_sql('the')} UNION ALL {_exact_sql('LE')}",
    "h17_direct_prefix": f"{_EK}, r AS (SELECT *, starts_with(w, 'Th') AS raw, max(starts_with(w, 'Th')::INTEGER) OVER (PARTITION BY dict_id) AS any_raw, (w <> 'Th' AND fold_w <> 'th')::INTEGER AS first FROM ek WHERE starts_with(fold_w, 'th')) SELECT dict_id, rank::INTEGER AS rank, id, w FROM (SELECT *, row_number() OVER (PARTITION BY dict_id ORDER BY first, id) AS rank FROM r WHERE raw OR any_raw = 0 OR first = 0) WHERE rank <= 30",
    "h18_follow_redirects": """WITH RECURSIVE l AS (SELECT p_partkey AS w, CASE WHEN p_partkey = 100 THEN 101 WHEN p_partkey = 101 THEN 100 ELSE p_partkey // 2 END AS t FROM part WHERE p_partkey >= 32),
r AS (SELECT w, t AS loc, 1 AS n FROM l UNION ALL SELECT r.w, l.t, n + 1 FROM r JOIN l ON l.w = r.loc WHERE n < 16)
SELECT 'parts' AS dict_id, l.w::VARCHAR AS w, e.loc AS id FROM l LEFT JOIN (SELECT DISTINCT w, loc FROM r WHERE loc < 32 AND loc IN (SELECT p_partkey FROM part)) e ON e.w = l.w""",
    "h19_path_variants": """WITH v AS (SELECT p_partkey, [p_name, replace(p_name, ' ', '_'), upper(replace(p_name, ' ', '_')[1]) || replace(p_name, ' ', '_')[2:], array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), '_')] AS a FROM part),
u AS (SELECT p_partkey, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM v) SELECT p_partkey, generate_subscripts(a, 1) - 1 AS k, unnest(a) AS variant FROM u""",
    "x8_lemma_file": "SELECT 'en' AS lang, form, lemma FROM (VALUES ('goes', 'go'), ('went', 'go'), ('gone', 'go'), ('ёлки', 'ёлка'), ('ёлку', 'ёлка'), ('saw', 'see'), ('seen', 'see'), ('saws', 'saw')) t(form, lemma)",
    "x7_lemma_lookup": "SELECT 'ru' AS lang, word, lemma FROM (VALUES (' Went ', 'go'), ('елки', 'ёлка'), ('Елку', 'ёлка'), ('saws', 'saw'), ('saw', 'see')) t(word, lemma)",
    "l6_lcid": f"SELECT c_custkey, CASE {_WHOLE} END AS code FROM (SELECT c_custkey, c_custkey + 900 AS l FROM customer)",
    "f17_analyzer": f"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all({fo.translate_sql("text || ' it''s c++ 3.14 the A.B'", 'fold')}, '[\\p{{L}}\\p{{N}}]+(?:[''&·.,][\\p{{L}}\\p{{N}}]+)*[+#]{{0,3}}'), lambda x: x NOT IN ({', '.join(map(fo.quoted, direct.STOP))}) AND strlen(x) <= 64) AS a FROM benchmark) SELECT item_id, generate_subscripts(a, 1) - 1 AS k, unnest(a) AS term FROM w""",
    "m2_stale": "SELECT c_custkey AS dict_id, concat_ws(',', CASE WHEN c_nationkey % 3 <> 2 THEN 'schema' END, CASE WHEN c_custkey % 4 <> 1 THEN 'reader' END) AS reasons FROM customer",
    "m5_leftovers": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY",
    "s12_classify": f"WITH {_FILES} SELECT kind, format, count(*) AS n FROM k GROUP BY ALL",
    "r1_companions": f"WITH {_FILES}, d AS (SELECT DISTINCT stem, name, kind FROM k) SELECT m.name AS main, coalesce(c.companions, '') AS companions FROM d m LEFT JOIN (SELECT stem, string_agg(name, '|' ORDER BY name) AS companions FROM d WHERE kind = 'companion' GROUP BY stem) c ON c.stem = m.stem WHERE m.kind = 'main'",
    "x15_list_tag": "SELECT md5(count(*) || '|' || sum(('0x' || substr(md5(n_nationkey || '|' || n_name || '|' || n_regionkey), 1, 12))::HUGEINT)::VARCHAR) AS tag FROM nation",
    "t19_resource_ladder": f"""WITH {q_library._RES}, r AS (SELECT name, min(seq) AS seq FROM res GROUP BY name), a AS (SELECT DISTINCT CASE WHEN seq % 2 = 0 THEN upper(name) ELSE name END AS asked FROM res),
c AS (SELECT asked, name, seq, 0 AS p FROM a JOIN r ON name = asked UNION ALL SELECT asked, name, seq, 1 FROM a JOIN r ON lower(name) = lower(asked)) SELECT asked, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY p, name) AS k FROM c) WHERE k = 1""",
    "k9_markdown": f"WITH {q_library._RAW_SQL} SELECT 'geo' AS dict_id, id, '## ' || n_name || chr(10) || (CASE WHEN alias_ <> n_name THEN '## ' || alias_ || chr(10) ELSE '' END) || {q_library._BODY} || chr(10) AS text FROM ini",
    "s8a_article_body": "SELECT page_id, md5(regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)) AS digest FROM pages",
    "s3b_text_to_html": "SELECT item_id, '<p>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>') || '</p>' AS body FROM benchmark",
}
