"""Registered queries on facets, upkeep, links and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions import fold as fo
from lexiquarry.operators import articles, languages, library, upkeep
from lexiquarry.plans import q_library, views
from lexiquarry.sources import formats

CODES = sorted(c for c, n in languages.NAMES.items() if " " not in n)
LANGUAGE_NAMES = [languages.NAMES[c] for c in CODES]


def _of(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _dictionaries(spark, d):
    """Suppliers as dictionaries whose titles, folders and declared languages name two languages in several ways."""
    n = F.col("s_suppkey")
    i, j = _of(CODES, n), _of(CODES, n * 7 + 3)
    name, other = _of(LANGUAGE_NAMES, n), _of(LANGUAGE_NAMES, n * 7 + 3)
    title = F.when(n % 4 == 0, F.concat(name, F.lit("-"), other, F.lit(" Dictionary"))).when(n % 4 == 1, "Plain words").when(n % 4 == 2, F.concat(F.lit("Plain ("), i, F.lit("-"), j, F.lit(") set"))).otherwise("新英和中辞典")
    path = F.when(n % 3 == 0, "/d/x/w.mdx").when(n % 3 == 1, F.concat(F.lit("/d/"), i, F.lit("-"), j, F.lit("/w.dsl.dz"))).otherwise(F.concat(F.lit("/d/y/"), i, F.lit("_small.zim")))
    return views.table(spark, d, "supplier", "s_suppkey").select(
        n.alias("dict_id"), title.alias("name"), path.alias("path"), F.when(n % 5 == 0, other).alias("declared"), F.when(n % 10 == 0, F.concat(name, F.lit(" (Modern)"))).alias("contents"),
        F.array(F.lit("/d"), F.lit("/e")).alias("roots"), F.when(n % 3 == 2, F.lit("kept:zim")).otherwise("dsl").alias("format"), F.when(n % 2 == 0, "Wiktionary;x").alias("tags"),
    )


RULES = [("kind", "plain", "sub", "plain"), ("kind", "small", "regex", r"_small\.")]


def l7_facets(spark, d):
    rules = spark.createDataFrame(RULES, "facet string, group_name string, kind string, pattern string")
    return languages.derived(_dictionaries(spark, d), rules)


def l11_article_language(spark, d):
    return _dictionaries(spark, d).select("dict_id", languages.article_language(*[F.col(c) for c in ("declared", "contents", "name", "path", "roots")]).alias("lang"))


def l12_lexical(spark, d):
    return _dictionaries(spark, d).select("dict_id", languages.lexical(F.col("format"), F.col("name"), F.col("tags")).alias("lexical"))


def m7_folders(spark, d):
    p = views.table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    n = F.col("p_partkey")
    path = F.concat(F.lit("/src/"), "p_brand", F.lit("/"), F.when(n % 9 == 0, F.repeat("p_name", F.lit(12))).otherwise(F.col("p_name")), F.when(n % 4 == 0, ": é?.").otherwise(""), _of([".mdx", ".dsl.dz", ".slob"], n))
    return upkeep.claimed(p.groupBy(path.alias("path")).agg(F.min(n).alias("made")))


def m8_adopted(spark, d):
    files = views.table(spark, d, "part", "p_partkey", "p_name").select(F.concat(F.lit("/lib/"), "p_name", _of([".text.db", ".MEDIA.db", ".txt"], F.col("p_partkey"))).alias("path")).distinct()
    return upkeep.adopted(files)


def m6_reconcile(spark, d):
    n = F.col("c_custkey")
    flag = lambda k: n % k != 0
    wants = [_of(["on", "off", "keep"], F.floor(n / 13)).alias("want_index"), _of(["on", "off", "keep", "repack", "leave"], F.floor(n / 17)).alias("want_media")]
    states = views.table(spark, d, "customer", "c_custkey").select(n.alias("dict_id"), *[flag(k).alias(c) for c, k in (("has_source", 7), ("has_text", 3), ("text_current", 2), ("has_index", 5), ("has_media", 4), ("media_current", 11))], *wants)
    return upkeep.plan(states)


def m11_lemma_groups(spark, d):
    p = views.table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type")
    lines = p.select(F.col("p_partkey").alias("line"), F.concat_ws("\t", "p_type", "p_name", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.col("p_brand"))).alias("value"))
    return upkeep.lemma_groups(lines).select("lemma", F.array_join("forms", "|").alias("forms"))


def r17_folded_redirects(spark, d):
    e, a, links = library.ingest(q_library._raw(spark, d))
    added, dangling = upkeep.folded_redirects(e, a, links)
    return added.select("dict_id", "entry_id", "seq", "w", F.lit("").alias("body")).unionByName(dangling.select("dict_id", F.lit(None).cast("long").alias("entry_id"), "seq", "w", "body"))


def r4_about(spark, d):
    n = views.table(spark, d, "nation", "n_nationkey", "n_name")
    text = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("1 < 2 & so on\r\nin "), "n_name", F.lit("\n \n\nEnd\n"))).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("<p>"), "n_name", F.lit("</p>"))).otherwise("  ")
    return n.select("n_nationkey", upkeep.about(text).alias("html"))


def r9_links(spark, d):
    """Links in all documents' texts, each with some of our own."""
    docs = views.table(spark, d, "documents", "doc_id", "text")
    text = F.concat("text", F.lit(" (see https://h.example/a.zip). x='HTTP://h.example/"), F.col("doc_id").cast("string"), F.lit("' http:// https://"))
    return docs.select("doc_id", F.posexplode(upkeep.links_in(text)).alias("k", "link"))


def r9_anchors(spark, d):
    more = "<A class='b' HREF='x&amp;y'>1</a><a href=#in>2</a><a href=bare>3</a><link href=no>"
    return views.table(spark, d, "pages", "page_id", "html").select("page_id", F.posexplode(upkeep.anchors(F.concat("html", F.lit(more)))).alias("k", "link"))


def r8_existing(spark, d):
    rows = views.table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_partkey")
    candidates = rows.select(F.col("l_orderkey").alias("archive"), F.concat(F.lit("File"), (F.col("l_partkey") % 400).cast("string")).alias("name"), F.col("l_quantity").cast("long").alias("size"))
    own = views.table(spark, d, "part", "p_partkey", "p_size").filter("p_partkey % 400 < 300").select(F.concat(F.lit("file"), (F.col("p_partkey") % 400).cast("string")).alias("name"), F.col("p_size").cast("long").alias("size"))
    return upkeep.existing(candidates, own)


def r10_catalogue(spark, d):
    n = views.table(spark, d, "nation", "n_nationkey", "n_name").withColumn("k", F.col("n_nationkey") % 5)
    code = F.when(F.col("k") == 0, "English").otherwise(F.lower(F.substring("n_name", 1, 2)))
    url = F.concat(F.when(F.col("k") == 1, "http").otherwise("https"), F.lit("://h/"), "n_name")
    item = F.struct(code.alias("code"), url.alias("url"), F.when(F.col("k") == 2, "x").otherwise(F.sha2("n_name", 256)).alias("sha256"), F.when(F.col("k") != 3, F.col("n_nationkey") + 1).alias("bytes"))
    return upkeep.catalogue(n.select(F.to_json(F.array(item)).alias("value")))


def r15_zim_links(spark, d):
    """Links of a page in a folder of a ZIM archive: up, down, from the root, outside."""
    n = views.table(spark, d, "part", "p_partkey", "p_name")
    name = F.col("p_name")
    tries = [F.concat(F.lit("../"), name, F.lit("/./x?q=1#f/..")), F.concat(F.lit("/I/"), name, F.lit("/..")), F.concat(F.lit("s/%2E%2e/"), name), F.concat(F.lit("../../../"), name, F.lit("?q")), F.concat(F.lit("https://h/"), name), F.lit("#top")]
    ref = F.element_at(F.array(*tries), (F.col("p_partkey") % 6 + 1).cast("int"))
    return n.select("p_partkey", upkeep.resolved_link(F.lit("A/b c/p?.html"), ref).alias("l")).select("p_partkey", "l.path", "l.query", "l.fragment")


def h20_titles(spark, d):
    return upkeep.by_title(views.store(spark, d)[0], "über", 15)


def k11_extract_plan(spark, d):
    return upkeep.extract_plan(q_library._resources(spark, d)).select("dict_id", "seq", "file")


STYLES = {0: ("", ""), 1: ("<b>", "</b>"), 2: ("<i>", "</i>")}


def s3c_styles(spark, d):
    p = views.table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", F.concat(F.lit("a`1`"), "p_name", F.lit("` 1``2`"), "p_type", F.lit("`9``300`end")).alias("raw"))
    return articles.mapped_column(p, "raw", "body", lambda t: formats.styled(t, STYLES)).select("p_partkey", "body")


_NAMES = "l7_facets l11_article_language l12_lexical m7_folders m8_adopted m6_reconcile m11_lemma_groups r17_folded_redirects r4_about r9_links r9_anchors r8_existing r10_catalogue r15_zim_links h20_titles k11_extract_plan s3c_styles".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_LIST = lambda values: "[" + ", ".join(map(fo.quoted, values)) + "]"
_N = len(CODES)
#: What each title, folder and declaration of ``_dictionaries`` states, by construction.
_DICTIONARIES = f"""d AS (SELECT s_suppkey AS n, {_LIST(CODES)}[s_suppkey % {_N} + 1] AS i, {_LIST(CODES)}[(s_suppkey * 7 + 3) % {_N} + 1] AS j FROM supplier),
s AS (SELECT *, CASE WHEN n % 5 = 0 THEN j WHEN n % 3 = 2 THEN i WHEN n % 4 IN (0, 2) THEN i END AS lang,
  CASE WHEN n % 10 = 0 THEN j WHEN n % 4 IN (0, 2) THEN i WHEN n % 4 = 3 THEN 'en' WHEN n % 3 = 1 THEN i END AS a, CASE WHEN n % 10 = 0 THEN i WHEN n % 4 IN (0, 2) THEN j WHEN n % 4 = 3 THEN 'ja' WHEN n % 3 = 1 THEN j END AS b FROM d),
names AS (SELECT unnest({_LIST(languages.NAMES)}) AS code, unnest({_LIST(languages.NAMES.values())}) AS label),
p AS (SELECT s.*, x.label AS la, y.label AS lb, z.label AS ll FROM s LEFT JOIN names x ON x.code = a LEFT JOIN names y ON y.code = b LEFT JOIN names z ON z.code = lang)"""
_BARE = r"regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\.dz$', ''), '\.[^.]*$', '')"

ORACLE_SQL = {
    "l7_facets": f"""WITH {_DICTIONARIES} SELECT n AS dict_id, 'lang' AS facet, 1 AS place, lang AS value, ll AS label FROM p WHERE lang IS NOT NULL
UNION ALL SELECT n, 'pair', 2, CASE WHEN a = b THEN a ELSE least(a, b) || '-' || greatest(a, b) END, CASE WHEN a = b THEN 'Monolingual ' || la WHEN lower(la) <= lower(lb) THEN la || ' ↔ ' || lb ELSE lb || ' ↔ ' || la END FROM p WHERE a IS NOT NULL
UNION ALL SELECT n, 'kind', 3, 'plain', 'plain' FROM p WHERE n % 4 IN (1, 2) UNION ALL SELECT n, 'kind', 3, 'small', 'small' FROM p WHERE n % 3 = 2""",
    "l11_article_language": f"WITH {_DICTIONARIES} SELECT n AS dict_id, coalesce(CASE WHEN n % 10 = 0 THEN i END, CASE WHEN n % 4 IN (0, 2) THEN j WHEN n % 4 = 3 THEN 'ja' WHEN n % 3 = 1 THEN j END, lang) AS lang FROM p",
    "l12_lexical": "SELECT s_suppkey AS dict_id, s_suppkey % 3 <> 2 OR s_suppkey % 2 = 0 AS lexical FROM supplier",
    "m7_folders": rf"""WITH f AS (SELECT '/src/' || p_brand || '/' || (CASE WHEN p_partkey % 9 = 0 THEN repeat(p_name, 12) ELSE p_name END) || (CASE WHEN p_partkey % 4 = 0 THEN ': é?.' ELSE '' END) || ['.mdx', '.dsl.dz', '.slob'][p_partkey % 3 + 1] AS path, p_partkey AS made FROM part),
g AS (SELECT path, min(made) AS made FROM f GROUP BY path), s AS (SELECT *, regexp_replace(trim(regexp_replace({_BARE}, '[:?]', '-', 'g')), '[ .]+$', '') AS safe, CASE WHEN ends_with(path, '.dsl.dz') THEN 'dsl' ELSE regexp_extract(path, '[^.]*$') END AS tag FROM g),
c AS (SELECT *, CASE WHEN strlen(safe) <= 80 THEN safe ELSE regexp_replace(trim(left(safe, list_max(list_filter(range(1, 81), lambda k: strlen(left(safe, k)) <= 80)))), '[ .]+$', '') END AS base FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY made, path) AS r FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY base, tag, r = 1 ORDER BY made, path) AS k FROM r)
SELECT path, CASE WHEN r = 1 THEN base WHEN k = 1 THEN base || ' (' || tag || ')' ELSE base || ' (' || tag || ' ' || k || ')' END AS folder FROM k""",
    "m8_adopted": "SELECT DISTINCT '/lib/' || p_name || ['.text.db', '.MEDIA.db'][p_partkey % 3 + 1] AS path, '/lib/' || p_name || ['/text.db', '/media.db'][p_partkey % 3 + 1] AS new_path FROM part WHERE p_partkey % 3 <> 2",
    "m6_reconcile": """WITH s AS (SELECT c_custkey AS n, c_custkey % 7 <> 0 AS src, c_custkey % 3 <> 0 AS txt, c_custkey % 2 <> 0 AS cur, c_custkey % 5 <> 0 AS idx, c_custkey % 4 <> 0 AS med, c_custkey % 11 <> 0 AS mcur,
  ['on', 'off', 'keep'][(c_custkey // 13) % 3 + 1] AS wi, ['on', 'off', 'keep', 'repack', 'leave'][(c_custkey // 17) % 5 + 1] AS wm FROM customer),
t AS (SELECT *, CASE WHEN src THEN (CASE WHEN NOT txt THEN 'build' WHEN NOT cur THEN 'rebuild' ELSE 'none' END) WHEN txt THEN 'none' ELSE 'error' END AS text FROM s)
SELECT n AS dict_id, text, CASE WHEN text = 'error' THEN 'none' WHEN wi = 'off' THEN (CASE WHEN idx THEN 'drop' ELSE 'none' END) WHEN wi = 'on' AND NOT idx THEN 'build' WHEN text IN ('build', 'rebuild') AND (wi = 'on' OR idx) THEN 'build' ELSE 'none' END AS "index",
  CASE WHEN wm = 'off' THEN (CASE WHEN med AND src THEN 'drop' ELSE 'none' END) WHEN wm = 'leave' OR (wm <> 'on' AND NOT med) THEN 'none' WHEN NOT src THEN 'error' WHEN wm = 'repack' OR NOT mcur OR text IN ('build', 'rebuild') THEN 'pack' ELSE 'none' END AS media FROM t""",
    "m11_lemma_groups": "WITH l AS (SELECT p_partkey AS line, lower(p_type) AS lemma, unnest([lower(p_name), lower(CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END)]) AS form, unnest([0, 1]) AS k FROM part), f AS (SELECT lemma, form, min(line * 10 + k) AS loc FROM l WHERE form <> lemma GROUP BY ALL) SELECT lemma, string_agg(form, '|' ORDER BY loc) AS forms FROM f GROUP BY lemma",
    "r17_folded_redirects": f"""WITH {q_library._RAW_SQL}, m AS (SELECT l.seq, l.w, l.target, i.id, CASE WHEN i.n_name = l.target OR i.alias_ = l.target THEN 1 ELSE 0 END AS same FROM links l LEFT JOIN ini i ON lower(i.n_name) = lower(l.target)), b AS (SELECT *, max(same) OVER (PARTITION BY seq) AS best FROM m)
SELECT 'geo' AS dict_id, id AS entry_id, seq, w, '' AS body FROM b WHERE id IS NOT NULL AND same = best UNION ALL SELECT 'geo', NULL, seq, w, '<p><a href="entry://' || target || '">' || target || '</a></p>' FROM b WHERE id IS NULL""",
    "r4_about": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '<p>1 &lt; 2 &amp; so on<br/>in ' || n_name || '</p><p>End</p>' WHEN 1 THEN '<p>' || n_name || '</p>' ELSE '' END AS html FROM nation",
    "r9_links": r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text || ' (see https://h.example/a.zip). x=''HTTP://h.example/' || doc_id || ''' http:// https://', '\s+'), lambda x: regexp_replace(regexp_extract(x, '(?i)https?://.*'), '[.,;:!?)\]}>"''`]+$', '')), lambda x: len(x) > 8) AS a FROM documents)
SELECT doc_id, generate_subscripts(a, 1) - 1 AS k, unnest(a) AS link FROM l""",
    "r9_anchors": rf"""WITH l AS (SELECT page_id, list_concat(list_filter(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1), lambda x: {q_library._unescape_sql('x')}), lambda x: x <> '' AND NOT starts_with(x, '#')), ['x&y', 'bare']) AS a FROM pages)
SELECT page_id, generate_subscripts(a, 1) - 1 AS k, unnest(a) AS link FROM l""",
    "r8_existing": """WITH c AS (SELECT DISTINCT l_orderkey AS archive, 'file' || (l_partkey % 400) AS name, l_quantity::BIGINT AS size FROM lineitem), o AS (SELECT DISTINCT 'file' || (p_partkey % 400) AS name, p_size::BIGINT AS size FROM part WHERE p_partkey % 400 < 300),
r AS (SELECT c.archive, c.name, bool_or(coalesce(o.size = c.size, false)) AS same, bool_or(o.name IS NOT NULL) AS known FROM c LEFT JOIN o ON o.name = c.name GROUP BY ALL)
SELECT archive, CASE WHEN bool_and(same) THEN 'files' WHEN bool_or(known) THEN 'name' ELSE 'no' END AS present FROM r GROUP BY archive""",
    "r10_catalogue": """WITH n AS (SELECT *, n_nationkey % 5 AS k FROM nation) SELECT CASE WHEN k = 0 THEN 'English' ELSE lower(left(n_name, 2)) END AS code, (CASE WHEN k = 1 THEN 'http' ELSE 'https' END) || '://h/' || n_name AS url, CASE WHEN k = 2 THEN 'x' ELSE sha256(n_name) END AS sha256,
CASE WHEN k <> 3 THEN n_nationkey::BIGINT + 1 END AS bytes, CASE k WHEN 0 THEN 'code' WHEN 1 THEN 'url' WHEN 2 THEN 'sha256' WHEN 3 THEN 'bytes' END AS problem FROM n""",
    "r15_zim_links": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'A/' || p_name || '/x' WHEN 1 THEN 'I/' WHEN 2 THEN 'A/b%20c/' || p_name WHEN 3 THEN p_name END AS path,
CASE p_partkey % 6 WHEN 0 THEN '?q=1' WHEN 3 THEN '?q' WHEN 1 THEN '' WHEN 2 THEN '' END AS query, CASE p_partkey % 6 WHEN 0 THEN '#f/..' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' END AS fragment FROM part""",
    "h20_titles": f"WITH {views.HEAD_SQL} SELECT dict_id, rank::INTEGER AS rank, id, w FROM (SELECT *, row_number() OVER (PARTITION BY dict_id ORDER BY CASE WHEN w IN ('über', 'Über') THEN 0 ELSE 1 END, w, id) AS rank FROM entry WHERE starts_with(w, 'über') OR starts_with(w, 'Über')) WHERE rank <= 15",
    "k11_extract_plan": rf"WITH {q_library._RES}, r AS (SELECT *, row_number() OVER (PARTITION BY dict_id, k ORDER BY seq, name) AS r FROM rk WHERE NOT {q_library._JUNK}) SELECT dict_id, seq, CASE WHEN r = 1 THEN k ELSE regexp_replace(k, '\.[^./]*$', '') || ' (' || r || ')' || regexp_extract(k, '\.[^./]*$') END AS file FROM r",
    "s3c_styles": "SELECT p_partkey, 'a<b>' || p_name || '` 1`</b><i>' || p_type || '</i>end' AS body FROM part",
}
