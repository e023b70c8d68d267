from lexiquarry.functions import text as tx
from lexiquarry.operators import articles, languages


def test_text_and_clean():
    page = '<head><title>x</title></head><p>one<br>two <b>b</b><script>no()</script><div>three<p>four'
    assert articles.article_text(page) == "x\none\ntwo b\nthree\nfour"
    assert articles.clean_html('<x><p onclick="a" title="t">a<script>b</script></x>&amp;<a href="javascript:x">l</a>') == '<p title="t">a&amp;<a>l</a></p>'


def test_marks():
    m = articles.Marker([(("the",), False), (("of", "th"), True), (("a",), True)])
    assert m.mark("The <b>of</b> these &the; other") == '<mark class="wu-hl">The</mark> <b><mark class="wu-hl">of</mark></b> <mark class="wu-hl">these</mark> &the; other'


def test_references():
    assert articles.rewrite_references('<base href="x"><img src="sound://a/b.png"><a href="#t">', "d") == '<img src="/res/d/a/b.png"><a href="#t">'


def test_globs():
    import re

    for glob, yes, no in [("*.png", "a/b/c.png", "c.pngx"), ("img/", "img/a/b", "x/img/a"), ("a/**/b", "a/b", "a/xb"), ("a/?", "a/b", "a/bc")]:
        assert re.match(tx.glob_regex(glob), yes) and not re.match(tx.glob_regex(glob), no)


def test_rules():
    rows, problems = languages.parse_rules("[a]\nx = One, `t,wo`\nbad\n")
    assert rows == [("a", "x", "sub", "one"), ("a", "x", "regex", "t,wo")] and len(problems) == 1


def test_displays():
    css = "/* .c { display: none } */ .a, span.b { color: red; display: block } @media print { .a { display: none } } .hid{display:none;} p .deep { display: block }"
    found = articles.css_displays(css)
    assert found["b"] == "block" and found["hid"] == "none" and "deep" not in found and "c" not in found
    assert articles.article_text('x<span class="b">y</span>z<span class="hid">no</span><p class="i">p</p>', {"b": "block", "hid": "none", "i": "inline"}) == "x\ny\nzp"


def test_scalars():
    from lexiquarry.functions import scalars

    assert [scalars.parse_size(x) for x in ("1GB", "10 kb", "7", "1.5M", "x", "")] == [1 << 30, 10 << 10, 7, 3 << 19, None, None]
    assert scalars.parse_list(" a, b ,,c ") == ["a", "b", "c"]
    assert [scalars.parse_count(x) for x in ("3", "-1", "all", "")] == [3, None, 0, None]
    assert scalars.keyword_range(10, 8, 5) == (8, 10) and scalars.keyword_range(10, 99, 5) == (10, 10) and scalars.keyword_range(10, -3, 0) == (0, 10)
