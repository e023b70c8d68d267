"""Every engine query with SQL gives DuckDB's rows on the smallest tables."""

import pytest

from lexiquarry.operators import articles
from lexiquarry.plans import registry
from lexiquarry.plans.q_library import MEDIA
from tests.parity import connect, rows_of_spark, rows_of_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert rows_of_spark(registry.QUERIES[name](spark, FOLDER)) == rows_of_sql(con, registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    """Queries without SQL give rows: one for each page, or each dictionary."""
    rows = registry.QUERIES[name](spark, FOLDER).collect()
    key = "page_id" if "page_id" in rows[0].asDict() else "dict_id"
    assert len({r[key] for r in rows}) == len(rows) == (spark.read.parquet(f"{FOLDER}/pages.parquet").count() if key == "page_id" else 20)


PLAIN = {
    "t1_mark": ("marked", articles.Marker([(("the",), False), (("of", "th"), True)]).mark),
    "t7_text": ("txt", articles.article_text),
    "t8_clean": ("clean", articles.clean_html),
    "t12_rewrite": ("rewritten", lambda h: articles.rewrite_references(h + MEDIA, "pages")),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_equals_the_plain_function(spark, name):
    column, change = PLAIN[name]
    html = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = {r.page_id: r[column] for r in registry.QUERIES[name](spark, FOLDER).collect()}
    assert got == {i: change(h) for i, h in html.items()} and any(got[i] != html[i] for i in got)
