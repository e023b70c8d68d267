"""Names, links, archives, styles, includes, stored indexes and progress, with values written by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiquarry import sources
from lexiquarry.api import Library
from lexiquarry.functions import text as tx
from lexiquarry.operators import articles, direct, languages, library, upkeep
from lexiquarry.sources import archives
from lexiquarry.sources import formats as rec


def values(spark, make, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


def test_links(spark):
    html = ['<a href="bword:word">', "<A HREF='BWORD://word'>", "<a href=bword:@x>", '<a href="entry://@x">', '<a href="@x">', '<a href="entry://word">', "bword:plain text"]
    assert values(spark, tx.canonical_links, html) == ['<a href="entry://word">', "<A HREF='entry://word'>", "<a href=entry:@x>", '<a href="entry:@x">', '<a href="@x">', '<a href="entry://word">', "bword:plain text"]
    assert values(spark, tx.encode_target, ["@home", "50% #1", "a\x00\x1f\x7fb", "x@y"]) == ["%40home", "50%25 %231", "a%00%1F%7Fb", "x@y"]
    assert values(spark, tx.is_relative_asset, ["/x", "x", "//h/x", "a:b", "#t", "?q", "", "../x"]) == [True, True, False, False, False, False, False, False]


def test_references_of_every_spelling(spark):
    page = """<img src='a b.png' srcset="s.png 1x,  dir/l.png 2x"><a href=bare.html><p style="background: url( 'p.gif' )"><style>i{x:url(q.png)}</style>"""
    assert values(spark, tx.references, [page]) == [["a b.png", "bare.html", "s.png", "dir/l.png", "p.gif", "q.png"]]
    got = articles.rewrite_references(page, "d")
    assert got == """<img src="/res/d/a b.png" srcset="/res/d/s.png 1x,  /res/d/dir/l.png 2x"><a href="/res/d/bare.html"><p style="background: url(/res/d/p.gif)"><style>i{x:url(/res/d/q.png)}</style>"""
    assert articles.rewrite_references(got, "d") == got
    assert articles.rewrite_references('<img src="../x.png"><img src="./y.png">', "d") == '<img src="../x.png"><img src="/res/d/y.png">'


def test_names(spark):
    assert values(spark, tx.resource_key, ["a\\B//./c", "../../x", "a/../b", "/", "", "A/b/.."]) == ["a/b/c", "x", "b", "", "", "a"]
    junk = [".DS_Store", "a\\Thumbs.db", "x/._y", "__MACOSX/z", ".git/config", "ehthumbs.db", ".fseventsd/1", "desktop.ini.txt", " .Trashes "]
    assert values(spark, tx.is_junk, junk) == [True, True, True, True, False, True, True, False, True]
    assert values(spark, tx.user_title, [" a\t\u2003b\x07\u0085c ", "x" * 199 + " y", "\x91\x00", None]) == ["a b c", "x" * 199, None, None]
    assert articles.composed("e\u0301") == "é"
    long = "ab" * 39 + "éé"
    paths = ["/s/big.dsl.dz", "/s/a: b?.mdx", f"/s/{long}.mdx", "/s/....mdx", "C:\\x\\Y z .slob", "/s/plain"]
    assert values(spark, upkeep.folder_name, paths) == ["big", "a- b-", "ab" * 39 + "é", "dictionary", "Y z", "plain"]
    assert values(spark, upkeep.format_tag, ["a.mdx", "a.dsl.dz", "a", "/x.y/a.gz"]) == ["mdx", "dsl", "alt", "gz"]


def test_languages_of_titles(spark):
    titles = ["Oxford Russian-English Dictionary", "Collins (En-Es) 2nd", "Anglo-Saxon", "e-book", "新英和中辞典", "语和汉语", "牛津高阶英汉双解词典", "big en_fr", "Foo-German-French", "English"]
    got = values(spark, lambda c: F.concat_ws(">", languages.two_languages(c)["first"], languages.two_languages(c)["second"]), titles)
    assert got == ["ru>en", "en>es", "", "", "en>ja", "", "en>zh", "en>fr", "de>fr", ""]
    rows = spark.createDataFrame([("/d/En-Ru/a/x.dsl", ["/d"]), ("/d/En-Ru/a/x.dsl", ["/d/En-Ru/a"]), ("/q/En-Ru/x.dsl", ["/d"]), ("/q/En-Ru/a/x.dsl", ["/d"])], "p string, r array<string>")
    assert [r.v and tuple(r.v) for r in rows.select(languages.folder_languages(F.col("p"), F.col("r")).alias("v")).collect()] == [("en", "ru"), None, ("en", "ru"), None]


def test_short_names_in_titles(spark):
    titles = ["Lao-Swahili Dictionary", "Swahili-Lao Dictionary", "A Lao primer", "Laos and Vietnamese", "Laotian", "Norwegian Nynorsk-Lao", *languages.NAMES.values()]
    assert values(spark, languages.from_title, titles) == ["lo", "sw", "lo", "vi", None, "nn", *languages.NAMES]


def test_every_language_in_derived_groups(spark):
    """Where only the title speaks, the first of its two names is the language group, for every language."""
    names = list(languages.NAMES.items())
    rows = [(k, f"{n}-{names[k - 1][1].split()[0]} Dictionary", "/d/x/w.mdx", None, None, ["/d"]) for k, (_, n) in enumerate(names)]
    dictionaries = spark.createDataFrame(rows, "dict_id int, name string, path string, declared string, contents string, roots array<string>")
    rules = spark.createDataFrame([], "facet string, group_name string, kind string, pattern string")
    got = {r.dict_id: (r.value, r.label) for r in languages.derived(dictionaries, rules).filter("facet = 'lang'").collect()}
    assert got == dict(enumerate(names))


def test_declared_languages_with_more_behind(spark):
    stated = ["Lao (Modern)", " LaoModernSort", "MalayalamSort", "Norwegian Bokmal (old)", "Other", "enough", *[n + " (Modern)" for n in languages.NAMES.values()]]
    assert values(spark, languages.declared, stated) == ["lo", "lo", "ml", "nb", None, None, *languages.NAMES]
    article = lambda c: languages.article_language(F.lit(None), c, F.lit("Lao-Swahili Dictionary"), F.lit("/d/x/w.mdx"), F.array(F.lit("/d")))
    assert values(spark, article, ["Lao (Modern)", "Thai (Modern)", "Other"]) == ["lo", "th", "sw"]


def test_redirect_targets_without_case(spark):
    entries = spark.createDataFrame([("d", 1, "Word"), ("d", 2, "other")], "dict_id string, id long, w string")
    chain = [("d", f"s{k}", f"S{k + 1}" if k % 2 else f"s{k + 1}") for k in range(50)] + [("d", "s50", "wORD"), ("d", "x", "y"), ("d", "y", "x"), ("d", "lost", "nowhere")]
    got = {r.w: r.id for r in direct.follow(entries, spark.createDataFrame(chain, "dict_id string, w string, target string")).collect()}
    assert all(got[f"s{k}"] == 1 for k in range(51)) and got["x"] is got["y"] is got["lost"] is None


def test_records_without_a_first_headword(spark):
    raw = spark.createDataFrame([("d", 0, [" ", "alias"], "b", "html", None), ("d", 1, ["w", "", "v", "w"], "b", "html", None), ("d", 2, [], "b", "html", None)], "dict_id string, seq long, headwords array<string>, body string, kind string, link_to string")
    entries, aliases, _ = library.ingest(raw)
    assert [(r.id, r.w) for r in entries.collect()] == [(1, "w")] and [r.w for r in aliases.collect()] == ["v"]


def test_styles_and_languages_of_markup():
    styles = rec.style_sheet("1\n<b>\n</b>\r\n2\n<i>\n</i>\nx\ny\nz")
    assert styles == {1: ("<b>", "</b>"), 2: ("<i>", "</i>")}
    assert rec.styled("a`1`b`2`c`2`", styles) == "a<b>b</b><i>c</i>" and rec.styled("no `x` token", styles) == "no `x` token"
    assert rec.styled("plain", {0: ("<p>", "</p>")}) == "<p>plain</p>" and rec.styled("`7`x", styles) == "x"
    assert rec.dsl_html("[lang id=1049]x[/lang]") == '<span data-lang="1049" lang="ru">x</span>'
    assert rec.dsl_html('[lang name="SpanishModernSort"]x[/lang]') == '<span data-lang="SpanishModernSort" lang="es">x</span>'
    assert rec.dsl_html("[lang id=23]x[/lang]") == '<span data-lang="23" lang="sr-Cyrl">x</span>'


def test_included_cards_and_archives(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "main.dsl").write_text('#NAME "m"\n#INCLUDE "Part.dsl"\none\n\tfirst\n', encoding="utf-16")
    (tmp_path / "d" / "part.dsl").write_text('#INCLUDE "deep.dsl"\n#INCLUDE "main.dsl"\ntwo\n\tsecond\n', encoding="utf-8")
    (tmp_path / "d" / "deep.dsl").write_bytes("three\n\tthird\n".encode())
    rows = sources.records(spark, str(tmp_path / "d")).collect()
    by = {}
    for r in rows:
        assert r.problem is None
        by.setdefault(r.dict_id.rsplit("/", 1)[-1], []).append(r.headwords[0])
    assert sorted(by["main"]) == ["one", "three", "two"] and sorted(by["deep"]) == ["three"]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name in ("x/a.ifo", "x/a.idx", "x/a.dict.dz", "x/readme.txt", "b.mdx", "b.mdd"):
            z.writestr(name, "1234")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "good.zip").write_bytes(packed.getvalue())
    (tmp_path / "z" / "bad.ZIP").write_bytes(b"nothing")
    members = archives.listed(spark, str(tmp_path / "z"))
    got = {r.main: (r.format, r.size, list(r.companions)) for r in archives.candidates(members).collect()}
    assert got == {"x/a.ifo": ("stardict", 4, ["x/a.dict.dz", "x/a.idx"]), "b.mdx": ("mdx", 4, ["b.mdd"])}
    assert [r.problem.split(":")[0] for r in members.filter("problem IS NOT NULL").collect()] == ["BadZipFile"]


@pytest.mark.parametrize("name, page", [("Словарь.dsl", "cp1251"), ("café noir.mdx", "cp1252"), ("кубок.txt", "cp866")])
def test_names_in_old_code_pages(name, page):
    shown, every = archives.readings(name.encode(page), False)
    assert name in every and (shown == name or page == "cp866")
    assert archives.readings(name.encode(), True) == (name, [name]) and archives.readings(b"plain.txt", False) == ("plain.txt", ["plain.txt"])


def test_parts_of_an_archive(spark, tmp_path):
    from tests.test_containers import zim

    data = zim(bytes, 1)
    for k, cut in enumerate((data[:100], data[100:120], data[120:])):
        (tmp_path / f"w.zima{'abc'[k]}").write_bytes(cut)
    (tmp_path / "one.zim").write_bytes(data)
    rows = sources.records(spark, str(tmp_path)).filter("problem IS NULL").collect()
    of = lambda stem: sorted((tuple(r.headwords), r.body, r.link_to) for r in rows if r.dict_id.endswith(stem))
    assert of("/w") == of("/one") != []


def test_stored_index(spark, tmp_path):
    raw = spark.createDataFrame([("d", k, [f"w{k}"], f"<p>the cat {k} sat" + (" on the mat" if k % 2 else ""), "html", None) for k in range(20)] + [("e", 0, ["x"], "the dog", "html", None)], "dict_id string, seq long, headwords array<string>, body string, kind string, link_to string")
    made = Library.of_records(raw)
    made.write(str(tmp_path / "s"))
    opened = Library.open(spark, str(tmp_path / "s"))
    key = lambda lib, q, **k: sorted((r.dict_id, r["rank"], r.id, r.rung) for r in lib.search(q, "fts", **k).collect())
    for q in ('"the mat"', "cat sat", "dog NOT cat", "zzz"):
        assert key(opened, q) == key(made, q) and key(opened, q, dictionaries=["d"]) == key(made, q, dictionaries=["d"])
    plan = opened.search("mat", "fts")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "StringStartsWith(term,mat)" in plan and "regexp_extract_all" not in plan
    assert Library.drop_index(spark, str(tmp_path / "s")) and not Library.drop_index(spark, str(tmp_path / "s"))
    assert Library.open(spark, str(tmp_path / "s")).index is None and key(Library.open(spark, str(tmp_path / "s")), "dog") == key(made, "dog")


def test_events_and_extraction(spark, tmp_path):
    spark.sparkContext.setJobGroup("g", "work")
    spark.range(100).repartition(3).count()
    text = upkeep.progress(spark, "g")
    assert text.startswith("event: progress\ndata: {") and '"state":"done"' in text and text.endswith("\n\n")
    assert '"state":"idle"' in upkeep.progress(spark, "none") and upkeep.version_signature({"b": 2, "a": 1}) == "a=1,b=2,"
    rows = spark.createDataFrame([("d", 0, "A/x.png", bytearray(b"1")), ("d", 1, "a\\X.png", bytearray(b"2")), ("d", 2, "../up", bytearray(b"3")), ("d", 3, ".DS_Store", bytearray(b"4"))], "dict_id string, seq long, name string, content binary")
    upkeep.extract(rows, str(tmp_path / "out"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"d/a/x.png": b"1", "d/a/x (2).png": b"2", "d/up": b"3"}
