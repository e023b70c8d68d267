"""Registered queries on articles, languages, facets and the library."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiquarry.functions import fold as fo
from lexiquarry.functions import text as tx
from lexiquarry.operators import articles, languages, library
from lexiquarry.plans import views


def _pages(spark, d):
    return views.table(spark, d, "pages", "page_id", "url", "html")


def f14_strip_html(spark, d):
    return _pages(spark, d).select("page_id", tx.strip_html(F.col("html")).alias("txt"))


def t5_fold(spark, d):
    t = views.tokens(spark, d).select("w").distinct()
    return t.select("w", fo.fold("w").alias("folded"), fo.lower1("w").alias("lowered"), fo.latin("w").alias("latin"))


def t6_display_text(spark, d):
    return _pages(spark, d).select("page_id", tx.display_text(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


def t7_text(spark, d):
    return articles.mapped_column(_pages(spark, d).select("page_id", "html"), "html", "txt", articles.article_text).select("page_id", "txt")


def t8_clean(spark, d):
    return articles.mapped_column(_pages(spark, d).select("page_id", "html"), "html", "clean", articles.clean_html).select("page_id", "clean")


def t1_mark(spark, d):
    marker = articles.Marker([(("the",), False), (("of", "th"), True)])
    return articles.mapped_column(_pages(spark, d).select("page_id", "html"), "html", "marked", marker.mark).select("page_id", "marked")


#: Markup with references of every spelling, added to each page.
MEDIA = """<img src='a b.png' srcset="s.png 1x, dir/l.png 2x"><a href=bare.html>x</a><p style="background: url( 'p.gif' )"><video poster="v.jpg"><style>i{background:url(q.png)}</style>"""


def t12_rewrite(spark, d):
    pages = _pages(spark, d).select("page_id", F.concat("html", F.lit(MEDIA)).alias("html"))
    return articles.mapped_column(pages, "html", "rewritten", lambda h: articles.rewrite_references(h, "pages")).select("page_id", "rewritten")


def t10_refs(spark, d):
    return _pages(spark, d).select("page_id", F.posexplode(tx.references(F.concat("html", F.lit(MEDIA)))).alias("k", "ref"))


def t11_assets(spark, d):
    """References to relative assets, by host: distinct names and how often they are used."""
    refs = _pages(spark, d).select(F.parse_url("url", F.lit("HOST")).alias("host"), F.explode(tx.references(F.col("html"))).alias("ref"))
    return refs.filter(tx.is_relative_asset(F.col("ref"))).groupBy("host", "ref").agg(F.count(F.lit(1)).alias("uses"))


def t13_canon_links(spark, d):
    to = F.element_at(F.array(*[F.lit(x) for x in ('href="bword:', "href='BWORD://", 'href="bword:@', "href = entry://@")]), (F.col("page_id") % 4 + 1).cast("int"))
    linked = F.replace(F.col("html"), F.lit('href="/'), to)
    return _pages(spark, d).select("page_id", F.md5(tx.canonical_links(linked)).alias("digest"))


def t14_targets(spark, d):
    t = views.table(spark, d, "part", "p_partkey", "p_name", "p_type")
    control = F.element_at(F.array(*[F.lit(chr(i)) for i in range(1, 32)]), (F.col("p_partkey") % 31 + 1).cast("int"))
    return t.select("p_partkey", tx.encode_target(F.concat(F.lit("@"), "p_name", control, F.lit("#50%@\x7f"))).alias("target"), tx.escape_attr(F.concat(F.lit('<"'), "p_type", F.lit('">&'))).alias("attr"))


def _resources(spark, d):
    """Part types as file names of a media pack: folders, case, junk."""
    t = views.table(spark, d, "part", "p_partkey", "p_brand", "p_name", "p_type", "p_size")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("png", "MP3", "css", "spx", "zip")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    name = F.concat(F.when(F.col("p_size") % 3 == 0, "img\\").when(F.col("p_size") % 7 == 0, "__MACOSX/").when(F.col("p_size") % 5 == 0, "../up/../a/").otherwise("./a//"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), ext)
    return t.select(F.col("p_brand").alias("dict_id"), F.col("p_partkey").alias("seq"), name.alias("name"))


def t16_resource_key(spark, d):
    r = _resources(spark, d)
    return r.select("seq", tx.resource_key(F.col("name")).alias("name_key"), tx.mime(F.col("name")).alias("mime"), tx.is_asset(F.col("name")).alias("is_asset"))


def t18_junk(spark, d):
    return _resources(spark, d).groupBy("dict_id").agg(F.count_if(tx.is_junk(F.col("name"))).alias("junk"), F.count(F.lit(1)).alias("files"))


def r6_resource_pick(spark, d):
    return library.pick(_resources(spark, d), ["img/**", "*.mp3"], ["**/*b*.png"]).select("dict_id", "seq")


def r7_path_collisions(spark, d):
    return library.collisions(_resources(spark, d))


def k7_media_pack(spark, d):
    return library.media_pack(_resources(spark, d)).groupBy("dict_id", "mime").agg(F.count(F.lit(1)).alias("files"))


def _raw(spark, d):
    """Raw records: nations as entries (with their capitalised spelling as an alias), suppliers as redirects."""
    n = views.table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    entries = n.select(F.lit("geo").alias("dict_id"), F.col("n_nationkey").cast("long").alias("seq"), F.array(F.concat(F.lit(" "), "n_name", F.lit(" ")), F.initcap("n_name"), F.lit(""), F.col("n_name")).alias("headwords"), F.concat(F.lit("region <"), F.col("n_regionkey").cast("string"), F.lit(">\nline")).alias("body"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("link_to"))
    s = views.table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey").join(n.select(F.col("n_nationkey").alias("k"), "n_name"), F.col("s_nationkey") == F.col("k"))
    target = F.when(F.col("s_suppkey") % 10 == 9, "nowhere").when(F.col("s_suppkey") % 2 == 0, F.upper("n_name")).otherwise(F.col("n_name"))
    links = s.select(F.lit("geo").alias("dict_id"), (F.col("s_suppkey") + 1000).alias("seq"), F.array("s_name").alias("headwords"), F.lit(None).cast("string").alias("body"), F.lit("html").alias("kind"), target.alias("link_to"))
    return entries.unionByName(links)


def k1_ingest(spark, d):
    e, a, _ = library.ingest(_raw(spark, d))
    own = a.groupBy(F.col("entry_id")).agg(F.concat_ws("|", F.sort_array(F.collect_list("w"))).alias("aliases"))
    return e.join(own, e["id"] == own["entry_id"], "left").select("dict_id", "id", "w", "body", F.coalesce("aliases", F.lit("")).alias("aliases"))


def k2_redirects(spark, d):
    e, _, r = library.ingest(_raw(spark, d))
    return library.resolve_redirects(e, r)


def k8_csv_rows(spark, d):
    e, a, r = library.ingest(_raw(spark, d))
    return library.csv_rows(e, a, r)


def k12_ndjson(spark, d):
    e, _, _ = library.ingest(_raw(spark, d))
    return library.ndjson(e, ["dict_id", "id", "w"])


def k14_fingerprint(spark, d):
    return library.fingerprint(views.doc_entry(spark, d), spark.createDataFrame([], "dict_id string, row long, w string, entry_id long"))


def m10_counters(spark, d):
    return library.counters(views.entry(spark, d))


def _known(spark, d):
    """Customers as prepared dictionaries, orders' customers as the files that are there."""
    c = views.table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    known = c.select(F.col("c_custkey").alias("dict_id"), F.concat(F.lit("/lib/"), "c_mktsegment", F.lit("/"), "c_name").alias("path"), F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("name"), (F.col("c_custkey") % 100).alias("size"), F.lit(1).alias("mtime"), F.md5(F.col("c_nationkey").cast("string")).alias("digest"), (F.col("c_custkey") % 11 == 0).alias("kept"))
    found = known.filter(F.col("dict_id") % 3 != 0).select("path", "name", "size", (F.col("dict_id") % 2 + 1).alias("mtime"), F.when(F.col("dict_id") % 4 == 1, "x").otherwise(F.col("digest")).alias("digest"))
    moved = known.filter(F.col("dict_id") % 6 == 0).select(F.concat(F.lit("/new"), "path").alias("path"), "name", "size", "mtime", "digest")
    return known, found, moved


def m1_source_changed(spark, d):
    known, found, _ = _known(spark, d)
    return library.changed(known, found)


def m3_orphans(spark, d):
    known, found, _ = _known(spark, d)
    return library.orphans(known, found).select("dict_id", "path")


def m4_relink(spark, d):
    known, found, moved = _known(spark, d)
    return library.relink(library.orphans(known, found), moved)


def m9_history(spark, d):
    ev = views.table(spark, d, "events", "event_id", "ts", "event_type", "user_id")
    log = ev.select(F.col("event_id").alias("seq"), "ts", F.concat(F.when(F.col("user_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.when(F.col("event_id") % 2 == 0, "\t").otherwise(" "), (F.col("user_id") % 900).cast("string"), F.lit("\n")).alias("word"))
    return library.history(log)


def r11_user_title(spark, d):
    c = views.table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    raw = F.when(F.col("c_custkey") % 9 == 0, " \t ").otherwise(F.concat(F.lit("  "), "c_name", F.lit("\t\t"), "c_mktsegment", F.lit("\u0007\u0091\u2003\u0085x ")))
    return c.select("c_custkey", tx.user_title(raw).alias("title"), tx.flag(F.when(F.col("c_custkey") % 3 == 0, "off").when(F.col("c_custkey") % 3 == 1, "Yes")).alias("flag"))


#: Own dictionary rows: id, name, path, declared language.
DICTIONARIES = [
    (1, "Oxford English Dictionary", "/dict/misc/oed.mdx", ""), (2, "Ru-En big", "/dict/x/big.dsl", ""), (3, "Wörterbuch German-French", "/dict/de/wb.slob", ""), (4, "Словарь", "/dict/y/slovar.mdx", ""),
    (5, "plain", "/dict/French/plain.ifo", ""), (6, "plain two", "/dict/z/es_small.dsl", ""), (7, "x", "/dict/a/b.zim", "Spanish (Modern)"), (8, "Notes of co-operative", "/dict/a/notes.md", ""),
    (9, "Lexicon (ru)", "/dict/a/l.md", ""), (10, "English-English Collins", "/dict/a/c.mdx", "eng"), (11, "Slovenians", "/dict/a/s.mdx", "ITA"), (12, "medical terms it>en", "/dict/med/terms.dsl", None),
]
RULES = "[subject]\nmedicine = medical, `\\bmed\\b`\nscience = chem, phys\n[publisher]\noxford = oxford\ncollins = collins, `^coll`\nbroken line\n"
LANGUAGE_ROWS = [(1, "en"), (2, "ru"), (3, "de"), (4, "ru"), (5, "fr"), (6, "es"), (7, "es"), (8, None), (9, "ru"), (10, "en"), (11, "it"), (12, None)]


def _dictionaries(spark):
    return spark.createDataFrame(DICTIONARIES, "dict_id int, name string, path string, declared string")


def l5_language(spark, d):
    return _dictionaries(spark).select("dict_id", languages.resolved(F.col("declared"), F.col("path"), F.col("name")).alias("lang"))


def l8_pair(spark, d):
    return _dictionaries(spark).select("dict_id", languages.pair(F.col("name")).alias("pair"))


def l10_rules_join(spark, d):
    rows, _ = languages.parse_rules(RULES)
    return languages.apply_rules(_dictionaries(spark), spark.createDataFrame(rows, "facet string, group_name string, kind string, pattern string"))


def l10_brand_rules(spark, d):
    """The same theta join on parts: names and types that a rule's substring occurs in."""
    rules = spark.createDataFrame([("colour", "green", "sub", "green"), ("colour", "red", "sub", "red"), ("make", "steel", "sub", "steel")], "facet string, group_name string, kind string, pattern string")
    parts = views.table(spark, d, "part", "p_partkey", "p_name", "p_type").select(F.col("p_partkey").alias("dict_id"), F.col("p_name").alias("name"), F.lower("p_type").alias("path"))
    return languages.apply_rules(parts, rules).groupBy("facet", "group_name").agg(F.count(F.lit(1)).alias("n"))


def x14_dictionary_list(spark, d):
    """Facts of each dictionary: entries, visible ones, aliases, language and total characters."""
    e, a = views.entry(spark, d), views.alias(spark, d)
    facts = e.groupBy("dict_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(~F.col("w").like("@_%")).alias("visible"), F.sum(F.char_length("w")).cast("long").alias("chars"))
    own = a.groupBy(F.col("dict_id").alias("_d")).agg(F.count(F.lit(1)).alias("aliases"))
    return facts.join(F.broadcast(own), F.col("dict_id") == F.col("_d"), "left").select("dict_id", "entries", "visible", "chars", F.coalesce("aliases", F.lit(0)).alias("aliases"))


def x16_preferences(spark, d):
    """Order of a library: pinned ones in their order, the rest by name, what is off left out."""
    n = views.table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    w = Window.orderBy(F.col("pin").isNull().cast("int"), "pin", "key", "n_nationkey")
    rows = n.filter("n_regionkey <> 2").select("n_nationkey", F.lower("n_name").alias("key"), F.when(F.col("n_nationkey") % 6 == 0, 30 - F.col("n_nationkey")).alias("pin"))
    return rows.select("n_nationkey", F.row_number().over(w).alias("place"))


_NAMES = """f14_strip_html t5_fold t6_display_text t7_text t8_clean t1_mark t12_rewrite t10_refs t11_assets t13_canon_links t14_targets t16_resource_key t18_junk r6_resource_pick r7_path_collisions k7_media_pack
k1_ingest k2_redirects k8_csv_rows k12_ndjson k14_fingerprint m10_counters m1_source_changed m3_orphans m4_relink m9_history r11_user_title l5_language l8_pair l10_rules_join l10_brand_rules x14_dictionary_list x16_preferences""".split()
QUERIES = {n: globals()[n] for n in _NAMES}


def _unescape_sql(e: str) -> str:
    for a, b in tx.ENTITIES:
        e = f"replace({e}, {fo.quoted(a)}, {fo.quoted(b)})"
    return e


_RES = """res AS (SELECT p_brand AS dict_id, p_partkey AS seq, (CASE WHEN p_size % 3 = 0 THEN 'img\\' WHEN p_size % 7 = 0 THEN '__MACOSX/' WHEN p_size % 5 = 0 THEN '../up/../a/' ELSE './a//' END) || replace(p_name, ' ', '_') || '.' || ['png', 'MP3', 'css', 'spx', 'zip'][p_partkey % 5 + 1] AS name FROM part),
rk AS (SELECT *, lower(array_to_string(list_filter(string_split(replace(replace(name, '\\', '/'), 'up/../', ''), '/'), lambda x: x NOT IN ('', '.', '..')), '/')) AS k, lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM res)"""
_MIME = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.MIME.items()) + " ELSE 'application/octet-stream' END"
_JUNK = "regexp_matches(name, " + fo.quoted(tx.JUNK) + ")"
_RAW_SQL = f"""n AS (SELECT n_nationkey::BIGINT AS seq, n_name, n_regionkey, row_number() OVER (ORDER BY n_nationkey) AS id FROM nation),
cap AS (SELECT *, upper(n_name[1]) || lower(n_name[2:]) AS c1 FROM n),
ini AS (SELECT *, array_to_string(list_transform(string_split(n_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS alias_ FROM cap),
links AS (SELECT s_suppkey + 1000 AS seq, s_name AS w, CASE WHEN s_suppkey % 10 = 9 THEN 'nowhere' WHEN s_suppkey % 2 = 0 THEN upper(n_name) ELSE n_name END AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_BODY = "'<p>region &lt;' || n_regionkey || '&gt;<br/>line</p>'"
_ALIAS = "CASE WHEN alias_ <> n_name THEN alias_ ELSE '' END"
_KNOWN_SQL = """known AS (SELECT c_custkey AS dict_id, '/lib/' || c_mktsegment || '/' || c_name AS path, c_mktsegment || (c_custkey % 50) AS name, c_custkey % 100 AS size, 1 AS mtime, md5(c_nationkey::VARCHAR) AS digest, c_custkey % 11 = 0 AS kept FROM customer),
found AS (SELECT dict_id AS fid, path, name, size, dict_id % 2 + 1 AS mtime, CASE WHEN dict_id % 4 = 1 THEN 'x' ELSE digest END AS digest FROM known WHERE dict_id % 3 <> 0),
moved AS (SELECT '/new' || path AS path, name, size, digest FROM known WHERE dict_id % 6 = 0),
lost AS (SELECT * FROM known WHERE NOT kept AND path NOT IN (SELECT path FROM found))"""
_BARE = lambda pattern: f"list_transform(regexp_extract_all(html, {fo.quoted(pattern)}, 1), lambda x: regexp_replace(x, '^[\"'']|[\"'']$', '', 'g'))"
_REFS = f"list_concat({_BARE(tx.REFERENCE)}, list_filter(list_concat(list_transform(flatten(list_transform({_BARE(tx.SOURCES)}, lambda x: regexp_split_to_array(trim(x), '\\s*,\\s+'))), lambda x: regexp_extract(x, '^\\S*')), {_BARE(tx.STYLE_URL)}), lambda x: x <> ''))"
_WITH_MEDIA = f"SELECT page_id, html || {fo.quoted(MEDIA)} AS html FROM pages"
_VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else fo.quoted(v) for v in r) + ")" for r in rows)

ORACLE_SQL = {
    "f14_strip_html": f"SELECT page_id, trim(regexp_replace({_unescape_sql(chr(39).join(['regexp_replace(regexp_replace(html, ', tx.RAW_ELEMENTS, ', ', '', ', ', 'g', '), ', tx.TAG, ', ', ' ', ', ', 'g', ')']))}, '\\s+', ' ', 'g')) AS txt FROM pages",
    "t5_fold": f"WITH {views.HEAD_SQL} SELECT DISTINCT w, {fo.translate_sql('w', 'fold')} AS folded, {fo.translate_sql('w', 'lower')} AS lowered, {fo.translate_sql('w', 'latin')} AS latin FROM token",
    "t6_display_text": f"SELECT page_id, {_unescape_sql(_unescape_sql(chr(39).join(['regexp_extract(html, ', '(?s)<title>(.*?)</title>', ', 1)'])))} AS title FROM pages",
    "t10_refs": f"SELECT page_id, generate_subscripts(r, 1) - 1 AS k, unnest(r) AS ref FROM (SELECT page_id, {_REFS} AS r FROM ({_WITH_MEDIA}))",
    "t11_assets": f"WITH r AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, unnest({_REFS}) AS ref FROM pages) SELECT host, ref, count(*) AS uses FROM r WHERE ref <> '' AND NOT regexp_matches(ref, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|#|\\?|//)') AND NOT contains(ref, '..') GROUP BY ALL",
    "t13_canon_links": "SELECT page_id, md5(replace(html, 'href=\"/', ['href=\"entry://', 'href=''entry://', 'href=\"entry:@', 'href = entry:@'][page_id % 4 + 1])) AS digest FROM pages",
    "t14_targets": "SELECT p_partkey, '%40' || p_name || printf('%%%02X', p_partkey % 31 + 1) || '%2350%25@%7F' AS target, '&lt;&#34;' || replace(replace(replace(p_type, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '&#34;&gt;&amp;' AS attr FROM part",
    "t16_resource_key": f"WITH {_RES} SELECT seq, k AS name_key, {_MIME} AS mime, ext IN ({', '.join(map(fo.quoted, tx.MIME))}) AS is_asset FROM rk",
    "t18_junk": f"WITH {_RES} SELECT dict_id, count(*) FILTER ({_JUNK}) AS junk, count(*) AS files FROM rk GROUP BY dict_id",
    "r6_resource_pick": f"WITH {_RES} SELECT dict_id, seq FROM rk WHERE (k LIKE 'img/%' OR k LIKE '%.mp3') AND NOT (k LIKE '%.png' AND regexp_matches(k, '^(.*/)?[^/]*b[^/]*\\.png$')) AND NOT {_JUNK}",
    "r7_path_collisions": f"WITH {_RES} SELECT dict_id, k AS path_key, count(*) AS n, min(name) AS first_name FROM rk GROUP BY dict_id, k HAVING count(*) > 1",
    "k7_media_pack": f"WITH {_RES}, f AS (SELECT *, row_number() OVER (PARTITION BY dict_id, k ORDER BY seq) AS r FROM rk WHERE NOT {_JUNK}) SELECT dict_id, {_MIME} AS mime, count(*) AS files FROM f WHERE r = 1 GROUP BY ALL",
    "k1_ingest": f"WITH {_RAW_SQL} SELECT 'geo' AS dict_id, id, n_name AS w, {_BODY} AS body, {_ALIAS} AS aliases FROM ini",
    "k2_redirects": f"WITH {_RAW_SQL} SELECT 'geo' AS dict_id, seq, w, target, entry_id FROM (SELECT l.seq, l.w, l.target, n.id AS entry_id, row_number() OVER (PARTITION BY l.seq ORDER BY (n.n_name <> l.target)::INTEGER, n.id) AS r FROM links l LEFT JOIN n ON {fo.translate_sql('n.n_name', 'lower')} = {fo.translate_sql('l.target', 'lower')}) WHERE r = 1",
    "k8_csv_rows": f"WITH {_RAW_SQL} SELECT 'geo' AS dict_id, n_name AS word, {_BODY} AS body, {_ALIAS} AS alts FROM ini UNION ALL SELECT 'geo', w, '<a href=\"entry://' || target || '\">' || target || '</a>', '' FROM links",
    "k12_ndjson": f"WITH {_RAW_SQL} SELECT '{{\"type\":\"hit\",\"dict_id\":\"geo\",\"id\":' || id || ',\"w\":\"' || n_name || '\"}}' AS line FROM n",
    "m10_counters": f"WITH {views.HEAD_SQL} SELECT dict_id, count(*) AS entries, count(DISTINCT w) AS distinct_headwords, count(*) FILTER (w LIKE '@_%') AS subs FROM entry GROUP BY dict_id",
    "m1_source_changed": f"WITH {_KNOWN_SQL} SELECT k.dict_id, f.path IS NOT NULL AND NOT (k.size = f.size AND k.mtime = f.mtime) AND k.digest <> f.digest AS changed FROM known k LEFT JOIN found f ON f.path = k.path",
    "m3_orphans": f"WITH {_KNOWN_SQL} SELECT dict_id, path FROM lost",
    "m4_relink": f"WITH {_KNOWN_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY name, size, digest ORDER BY dict_id) AS k FROM lost), b AS (SELECT *, row_number() OVER (PARTITION BY name, size, digest ORDER BY path) AS k FROM moved) SELECT a.dict_id, a.path, b.path AS new_path FROM a JOIN b ON a.name = b.name AND a.size = b.size AND a.digest = b.digest AND a.k = b.k",
    "m9_history": f"WITH l AS (SELECT event_id AS seq, ts, (CASE WHEN user_id % 2 = 0 THEN upper(event_type) ELSE event_type END) || ' ' || (user_id % 900) AS word FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY {fo.translate_sql('word', 'lower')} ORDER BY ts DESC, seq DESC) AS r FROM l) SELECT pos::INTEGER AS pos, word FROM (SELECT word, row_number() OVER (ORDER BY ts DESC, seq DESC) AS pos FROM o WHERE r = 1) WHERE pos <= 500",
    "r11_user_title": "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE left(c_name || ' ' || c_mktsegment || ' x', 200) END AS title, coalesce(CASE WHEN c_custkey % 3 = 0 THEN false WHEN c_custkey % 3 = 1 THEN true END, false) AS flag FROM customer",
    "l5_language": f"SELECT dict_id::INTEGER AS dict_id, lang FROM (VALUES {_VALUES(LANGUAGE_ROWS)}) t(dict_id, lang)",
    "l8_pair": "SELECT dict_id::INTEGER AS dict_id, pair FROM (VALUES (1, NULL), (2, 'en-ru'), (3, 'de-fr'), (4, NULL), (5, NULL), (6, NULL), (7, NULL), (8, NULL), (9, NULL), (10, 'Monolingual'), (11, NULL), (12, 'en-it')) t(dict_id, pair)",
    "l10_rules_join": "SELECT dict_id::INTEGER AS dict_id, facet, group_name FROM (VALUES (1, 'publisher', 'oxford'), (10, 'publisher', 'collins'), (12, 'subject', 'medicine')) t(dict_id, facet, group_name)",
    "l10_brand_rules": "SELECT facet, group_name, count(*) AS n FROM part JOIN (VALUES ('colour', 'green', 'green'), ('colour', 'red', 'red'), ('make', 'steel', 'steel')) r(facet, group_name, pattern) ON contains(lower(p_name), pattern) OR contains(lower(p_type), pattern) GROUP BY ALL",
    "x14_dictionary_list": f"WITH {views.HEAD_SQL} SELECT e.dict_id, e.entries, e.visible, e.chars, coalesce(a.aliases, 0) AS aliases FROM (SELECT dict_id, count(*) AS entries, count(*) FILTER (NOT w LIKE '@_%') AS visible, sum(len(w))::BIGINT AS chars FROM entry GROUP BY dict_id) e LEFT JOIN (SELECT dict_id, count(*) AS aliases FROM alias GROUP BY dict_id) a ON a.dict_id = e.dict_id",
    "x16_preferences": "SELECT n_nationkey, row_number() OVER (ORDER BY (pin IS NULL)::INTEGER, pin, lower(n_name), n_nationkey)::INTEGER AS place FROM (SELECT *, CASE WHEN n_nationkey % 6 = 0 THEN 30 - n_nationkey END AS pin FROM nation WHERE n_regionkey <> 2)",
}
