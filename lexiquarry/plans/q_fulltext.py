"""Registered full-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiquarry.functions.fold import translate_sql
from lexiquarry.operators import fulltext, ftsq
from lexiquarry.operators.ftsq import Near, Op, Phrase
from lexiquarry.plans import views


def _index(spark, d):
    return views.held(spark, d, "postings", lambda: _built(spark, d))


def _built(spark, d):
    return fulltext.postings(views.doc_entry(spark, d).select("dict_id", "id", "body"))


def _p(*terms, open=False):
    return Phrase(tuple(terms), open)


def k4_postings(spark, d):
    """The inverted index, by term: documents, places and the sum of places."""
    return _built(spark, d).groupBy("dict_id", "term").agg(F.countDistinct("id").alias("docs"), F.count(F.lit(1)).alias("places"), F.sum("pos").cast("long").alias("pos_sum"))


def f10_tokens(spark, d):
    return _index(spark, d).groupBy("dict_id", "id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("term")).cast("long").alias("chars"))


def _ids(node):
    def run(spark, d):
        return fulltext.matches(_index(spark, d), node)

    return run


f6_phrase = _ids(_p("of", "the"))
f6_phrase_open = _ids(_p("the", "en", open=True))
f7_near = _ids(Near((_p("the"), _p("of"), _p("and")), 3))
f7_near_phrases = _ids(Near((_p("of", "the"), _p("and")), 2))
f8_and = _ids(Op("and", _p("the"), _p("with")))
f8_or = _ids(Op("or", _p("avec"), _p("nicht")))
f8_not = _ids(Op("not", _p("the"), _p("of")))
f8_nested = _ids(ftsq.parse("(un OR le) la NOT avec").node)
f9_prefix_term = _ids(_p("schl", open=True))


def f4_ladder(spark, d):
    return fulltext.ladder(_index(spark, d), ftsq.parse("of the that"))


def f13_bag(spark, d):
    """Every white-space word as an open term, all of them."""
    return fulltext.matches(_index(spark, d), ftsq.parse("tion ou en").rungs[-1][1])


def f16_bm25(spark, d):
    return fulltext.bm25_lengths(_index(spark, d), ["the", "that"], 5)


def f11_bm25_terms(spark, d):
    return fulltext.bm25_terms(_index(spark, d), ["with", "that"], 5)


def f19_expand(spark, d):
    return fulltext.expand(_index(spark, d), "th", 40)


def f18_cjk_bigrams(spark, d):
    """Pairs of neighbouring characters, on the names of nations (the tables hold no CJK text)."""
    return views.table(spark, d, "nation", "n_nationkey", "n_name").select("n_nationkey", F.explode(fulltext.cjk_terms(F.col("n_name"))).alias("term")).groupBy("n_nationkey", "term").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    k: v
    for k, v in globals().items()
    if k in ("k4_postings", "f10_tokens", "f6_phrase", "f6_phrase_open", "f7_near", "f7_near_phrases", "f8_and", "f8_or", "f8_not", "f8_nested", "f9_prefix_term", "f4_ladder", "f13_bag", "f16_bm25", "f11_bm25_terms", "f19_expand", "f18_cjk_bigrams")
}

_WITH = rf"""WITH lists AS (SELECT source AS dict_id, doc_id AS id, regexp_extract_all({translate_sql("text", "latin")}, '{fulltext.TERM}') AS l FROM documents),
p AS MATERIALIZED (SELECT dict_id, id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos FROM lists)"""
_HAS = lambda t: f"SELECT DISTINCT dict_id, id FROM p WHERE term = '{t}'"
_STARTS = lambda t: f"SELECT DISTINCT dict_id, id FROM p WHERE starts_with(term, '{t}')"


def _near_sql(parts: list[str], within: int) -> str:
    """Occurrences (dict_id, id, loc, n) of each part; the last of each so far, and the gap from the earliest one's end."""
    k = len(parts)
    rows = " UNION ALL ".join(f"SELECT *, {i} AS k FROM ({q})" for i, q in enumerate(parts))
    lasts = ", ".join(f"max(CASE WHEN k = {i} THEN [loc, n] END) OVER w AS l{i}" for i in range(k))
    every = " AND ".join(f"l{i} IS NOT NULL" for i in range(k))
    first = f"list_min([{', '.join(f'[l{i}[1], l{i}[1] + l{i}[2]]' for i in range(k))}])[2]"
    return f"SELECT DISTINCT dict_id, id FROM (SELECT *, {lasts} FROM ({rows}) WINDOW w AS (PARTITION BY dict_id, id ORDER BY loc, k ROWS UNBOUNDED PRECEDING)) WHERE {every} AND greatest({', '.join(f'l{i}[1]' for i in range(k))}) - {first} <= {within}"


_ONE = lambda t: f"SELECT dict_id, id, pos AS loc, 1 AS n FROM p WHERE term = '{t}'"
_OPEN = lambda t: f"SELECT dict_id, id, pos AS loc, 1 AS n FROM p WHERE starts_with(term, '{t}')"
_TWO = lambda a, b: f"SELECT x.dict_id, x.id, x.pos AS loc, 2 AS n FROM p x JOIN p y ON x.dict_id = y.dict_id AND x.id = y.id AND y.pos = x.pos + 1 WHERE x.term = '{a}' AND y.term = '{b}'"
_SIZE = "size AS (SELECT dict_id, count(*) AS docs, avg(len) AS mean FROM lens GROUP BY dict_id)"


def _bm25(terms: str, weight: str, part: str) -> str:
    return f"""{_WITH}, lens AS (SELECT dict_id, id, count(*) AS len FROM p GROUP BY ALL), {_SIZE},
tf AS (SELECT dict_id, id, term, count(*) AS wdf FROM p WHERE term IN ({terms}) GROUP BY ALL), df AS (SELECT dict_id, term, count(*) AS df FROM tf GROUP BY ALL),
r AS (SELECT tf.*, df.df, s.docs, s.mean, l.len, (s.docs - df.df + 0.5) / (df.df + 0.5) AS raw FROM tf JOIN df ON df.dict_id = tf.dict_id AND df.term = tf.term JOIN size s ON s.dict_id = tf.dict_id JOIN lens l ON l.dict_id = tf.dict_id AND l.id = tf.id),
w AS (SELECT *, {weight} AS weight FROM r), sc AS (SELECT dict_id, id, round(sum({part}), 6) AS score FROM w GROUP BY dict_id, id)
SELECT dict_id, rank::INTEGER AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY dict_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 5"""


_LADDER = [
    "SELECT DISTINCT x.dict_id, x.id FROM p x JOIN p y ON x.dict_id = y.dict_id AND x.id = y.id AND y.pos = x.pos + 1 JOIN p z ON x.dict_id = z.dict_id AND x.id = z.id AND z.pos = x.pos + 2 WHERE x.term = 'of' AND y.term = 'the' AND starts_with(z.term, 'that')",
    _near_sql([_OPEN("of"), _OPEN("the"), _OPEN("that")], 10),
    f"{_STARTS('of')} INTERSECT {_STARTS('the')} INTERSECT {_STARTS('that')}",
]

ORACLE_SQL = {
    "k4_postings": f"{_WITH} SELECT dict_id, term, count(DISTINCT id) AS docs, count(*) AS places, sum(pos)::BIGINT AS pos_sum FROM p GROUP BY dict_id, term",
    "f10_tokens": f"{_WITH} SELECT dict_id, id, count(*) AS n, sum(len(term))::BIGINT AS chars FROM p GROUP BY dict_id, id",
    "f6_phrase": f"{_WITH} SELECT DISTINCT dict_id, id FROM ({_TWO('of', 'the')})",
    "f6_phrase_open": f"{_WITH} SELECT DISTINCT x.dict_id, x.id FROM p x JOIN p y ON x.dict_id = y.dict_id AND x.id = y.id AND y.pos = x.pos + 1 WHERE x.term = 'the' AND starts_with(y.term, 'en')",
    "f7_near": f"{_WITH} {_near_sql([_ONE('the'), _ONE('of'), _ONE('and')], 3)}",
    "f7_near_phrases": f"{_WITH} {_near_sql([_TWO('of', 'the'), _ONE('and')], 2)}",
    "f8_and": f"{_WITH} {_HAS('the')} INTERSECT {_HAS('with')}",
    "f8_or": f"{_WITH} {_HAS('avec')} UNION {_HAS('nicht')}",
    "f8_not": f"{_WITH} {_HAS('the')} EXCEPT {_HAS('of')}",
    "f8_nested": f"{_WITH} ({_STARTS('un')} UNION {_STARTS('le')}) INTERSECT ({_STARTS('la')} EXCEPT {_STARTS('avec')})",
    "f9_prefix_term": f"{_WITH} {_STARTS('schl')}",
    "f4_ladder": f"{_WITH}, r AS ({' UNION ALL '.join(f'SELECT *, {i} AS rung FROM ({q})' for i, q in enumerate(_LADDER))}) SELECT dict_id, id, ['phrase', 'near', 'words'][rung + 1] AS rung FROM (SELECT *, min(rung) OVER (PARTITION BY dict_id) AS best FROM r) WHERE rung = best",
    "f13_bag": f"{_WITH} {_STARTS('tion')} INTERSECT {_STARTS('ou')} INTERSECT {_STARTS('en')}",
    "f16_bm25": _bm25("'the', 'that'", "ln(CASE WHEN raw < 2 THEN raw * 0.5 + 1 ELSE raw END) * 2.0", "weight * wdf / ((0.5 * greatest(len / mean, 0.5) + 0.5) + wdf)"),
    "f11_bm25_terms": _bm25("'with', 'that'", "greatest(ln(raw), 0.000001)", "weight * wdf * 2.2 / (wdf + 1.2)"),
    "f19_expand": f"{_WITH}, t AS (SELECT DISTINCT dict_id, term FROM p WHERE starts_with(term, 'th')), k AS (SELECT *, row_number() OVER (PARTITION BY dict_id ORDER BY term) AS k, count(*) OVER (PARTITION BY dict_id) AS n FROM t) SELECT dict_id, term, n > 40 AS more FROM k WHERE k <= 40",
    "f18_cjk_bigrams": "WITH c AS (SELECT n_nationkey, n_name AS s, unnest(range(1, len(n_name) + 1)) AS i FROM nation), t AS (SELECT n_nationkey, s[i : i] AS term FROM c UNION ALL SELECT n_nationkey, s[i : i + 1] FROM c WHERE i < len(s)) SELECT n_nationkey, term, count(*) AS n FROM t GROUP BY ALL",
}
