"""Extraction, tokenisation and classification: exact round trips, the library's own ids, held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexiquarry.llm import bpe, language, lexicon, pieces, tokenfiles, toxicity, wrappers
from lexiquarry.llm.common import text_buffers

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "<|endoftext|>x<|startoftext|>"), (5, "Σίσυφος İstanbul éé 한국 \U0001f600"), (5, "dup"), (None, "null id"), (6, "ab" * 30_000), (7, "12 34,5 it's we'll 'S\x85\x1c 　z")]


def fuzz(n):
    rng = random.Random(5)
    alphabet = "abcABC ΣσςİıßÉé́̀<|endoftext|>'s'll12٣  \x85\x1c\x1f\x0b漢字\U0001f600\x00.,!-\n\tÅ한"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_lexicon_is_exact_and_minimal():
    rng = random.Random(2)
    for _ in range(60):
        m = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6))): tuple(rng.randint(0, 3) for _ in range(rng.randint(0, 4))) for _ in range(40)}
        b = lexicon.Builder()
        for w in sorted(m):
            b.add(w, m[w])
        read = lexicon.Lexicon(b.finish())
        assert len(b.states) == len(set(b.states))
        asked = [*m, b"", b"zz", b"abcabcabc"]
        assert read.look_up(asked) == [m.get(w) for w in asked]
    assert lexicon.Lexicon(lexicon.Builder().finish()).look_up([b"a"]) == [None]


def test_word_bpe_equals_the_library(spark):
    path = bpe.tokenizer_path()
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(fuzz(300))] + [(i, t) for i, t in ODD if i != 5 or t != "dup"]
    frame = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash"))
    got = {(r.doc_id, r.n_tokens, tuple(r.ids), r.decoded, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(frame, path, ["doc_id", "ids"], ["n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"], listed=64).collect()}
    want = set()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((i, len(ids), tuple(ids), text, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    assert bpe.with_ids(spark.createDataFrame([], DOCS), path).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    path = tokenfiles.tokenizer_path()
    library = Tokenizer.from_file(path)
    rows = [(i + 100, t) for i, t in enumerate(fuzz(200))] + ODD
    frame = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash"))
    folder = str(tmp_path / "tokens")
    tokenfiles.write_tokens(frame, folder, path)
    back = tokenfiles.read_tokens(spark, folder)
    got = [tuple(r.ids) for r in tokenfiles.places(back).orderBy("start").collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert got == [tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,) for _, t in ordered]
    narrow = tokenfiles.read_tokens(spark, folder, F.col("doc_id") == 150, ["doc_id", "n_tokens"])
    plan = narrow._jdf.queryExecution().toString()
    assert narrow.count() == 1 and "ids" not in plan.split("ReadSchema")[-1] and "EqualTo(doc_id,150)" in plan
    tokenfiles.write_tokens(spark.createDataFrame([], DOCS), str(tmp_path / "none"), path)
    assert tokenfiles.read_tokens(spark, str(tmp_path / "none")).count() == 0


def every_code_point(step=64):
    """Texts in which every code point that may matter stands between letters, digits, spaces and signs."""
    codes = pieces.scalars()
    # Beyond the last letters and digits, private use and unassigned ones only: one in 61 of those.
    codes = codes[(codes < 0x33480) | (codes > 0xE0000) & (codes < 0xE0200) | (codes % 61 == 0)]
    return ["".join("ab%scd 1%s2 %s !%s'%ss " % ((chr(c),) * 5) for c in codes[i : i + step]) for i in range(0, len(codes), step)]


def test_token_files_equal_the_library_on_every_code_point():
    with open(tokenfiles.tokenizer_path(), "rb") as f:
        data = f.read()
    library = Tokenizer.from_file(tokenfiles.tokenizer_path())
    bpe_ = tokenfiles.ByteBpe(data, tokenfiles.piece_kinds(data))
    rng = random.Random(1)
    texts = every_code_point() + ["".join(rng.choice("ab 'sStTreveml lld12 \n\t é!") for _ in range(rng.randint(0, 14))) for _ in range(20_000)] + ["", " ", "<|endoftext|> x"]
    for k in range(0, len(texts), 500):
        own = texts[k : k + 500]
        ids, ends = bpe_.encode(*text_buffers(pa.array(own)))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [e.ids for e in library.encode_batch(own, add_special_tokens=False)]


def test_word_bpe_equals_the_library_on_every_code_point():
    with open(bpe.tokenizer_path(), "rb") as f:
        data = f.read()
    library, about, merges = Tokenizer.from_file(bpe.tokenizer_path()), bpe.tables(data), bpe.WordBpe(data)
    encoder = bpe.Encoder(merges, about, lexicon.Lexicon(bpe.compiled(merges, [b"the", b"and"])))
    rng = random.Random(3)
    rare = [chr(c) for c in pieces.scalars() if not about[2][c]]
    texts = every_code_point() + [" ".join("".join(rng.choice(rare) if rng.random() < 0.3 else rng.choice("aEo '̧́ᅡᆨᄀ가Σß") for _ in range(rng.randint(1, 6))) for _ in range(40)) for _ in range(1500)] + fuzz(3000)
    for k in range(0, len(texts), 500):
        own = texts[k : k + 500]
        for (ids, at), e in zip(encoder.encode(*text_buffers(pa.array(own))), library.encode_batch(own, add_special_tokens=False), strict=True):
            assert ids.tolist() == e.ids and b" ".join(encoder.decoded[i] for i in at).decode() == library.decode(e.ids, skip_special_tokens=False)


def test_memory_forgets_and_numbers_anew():
    met = []

    class Short(pieces.Memory):
        def reset(self):
            super().reset()
            met.clear()

        def learn(self, words):
            met.extend(words)

    memory, rng = Short(300), random.Random(4)
    for _ in range(60):
        words = [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([1, 2, 8, 9, 15, 16, 17, 40]))) for _ in range(50)]
        size = np.array([len(w) for w in words])
        numbers = memory.numbers(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size)
        assert [met[n] for n in numbers] == words and len(met) == len(set(met)) <= 300


def test_op9_and_op6_on_a_table(spark):
    byte, word = Tokenizer.from_file(tokenfiles.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    nine = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.op9_token_files(spark, FOLDER).collect()}
    six = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in bpe.op6_word_bpe(spark, FOLDER).collect()}
    start = 0
    for i, t in docs:
        ids = np.array([*byte.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert nine[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        own = word.encode(t, add_special_tokens=False).ids
        assert six[i] == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())


ARTICLE = "<article><h1>A title</h1><p>First &amp; <b>bold<p>Second<br>line</article>"
SHELL = '<html><head><title>t</title><style>p{{}}</style><script>var x="</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies</div>{}<div id="comments"><p>I agree</p></div><aside>More</aside><form>Go<input></form><footer>&copy; us</footer></body></html>'


def test_main_text_of_single_pages():
    assert wrappers.main_text(SHELL.format(ARTICLE)) == "A title\n\nFirst & bold\n\nSecond line"
    assert wrappers.main_text(SHELL.format("<div class=post><h1>T</h1><p>body text here</p></div>")) == "T\n\nbody text here"
    wide = '<div class="page with-sidebar"><article><div class="article-header"><h1>T</h1></div><p>p</p><div class="share">s</div></article><article class="comment"><p>no</p></article></div><div class="header">site</div>'
    assert wrappers.main_text(wide) == "T\n\np"
    for text in ("", None, "<", "<p", "<script>", "<!--", "<a href='", "&", "<article>", "<p title='x"):
        assert wrappers.main_text(text) in ("", "<", "&")


def test_wrapper_induction(spark):
    host = "http://h.example/"
    page = lambda k: f"<html><body><div><div>Welcome to the site</div><div><h2>Head {k}</h2><p>Text number {k} of this page</p><p>Read more at our site</p></div></div></body></html>"
    rows = [(k, f"{host}{k}", page(k)) for k in range(12)] + [(90, None, None), (91, "x", ""), (92, f"{host}cut", page(92)[:90]), (93, host, SHELL.format(ARTICLE)), (None, host, "<p>p</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", F.lit("clash")).withColumn("text", F.lit(1))
    got = {r.page_id: r.text for r in wrappers.extracted(frame).collect()}
    assert all(got[k] == f"Head {k}\n\nText number {k} of this page" for k in range(12))
    assert got[90] == got[91] == "" and got[93] == "A title\n\nFirst & bold\n\nSecond line"
    assert wrappers.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_host_of_copies_keeps_its_text(spark):
    frame = spark.createDataFrame([(k, f"http://c/{k}", SHELL.format(ARTICLE)) for k in range(9)], "page_id long, url string, html string")
    assert {r.text for r in wrappers.extracted(frame).collect()} == {"A title\n\nFirst & bold\n\nSecond line"}


def test_main_text_keeps_all_regions():
    assert wrappers.main_text(f"<body><h1>Title</h1><p>lead</p><div><p>{'long text ' * 30}</p><p>b</p></div><p>end</p></body>") == f"Title\n\nlead\n\n{('long text ' * 30).strip()}\n\nb\n\nend"
    assert wrappers.main_text("<article><p>first</p></article><article class=comment>no</article><div><article><p>second, longer</p></article></div>") == "first\n\nsecond, longer"
    assert wrappers.main_text("<main><h1>Story</h1><p>All of the story</p></main><div><article>Teaser</article></div>") == "Story\n\nAll of the story"
    assert wrappers.main_text("<main><h1>Story</h1><p>All of the story</p><article>Teaser</article></main>") == "Story\n\nAll of the story\n\nTeaser"
    assert wrappers.main_text("<main>Hi</main><article>All of the story</article>") == "All of the story"


def test_names_of_elements():
    """What a name tells against goes; what only resembles such a name stays."""
    keep = ["related-work", "side-by-side", "with-sidebar", "adder", "noticeable", "address-header-less"]
    drop = ["related-posts", "ad", "ad-slot-2", "share-buttons", "site cookie-notice", "newsletter-signup", "sidebar left", "comment-list"]
    page = lambda name: f'<article><h1>T</h1><p>one</p><div class="{name}">inside</div><p>two</p></article>'
    for name in keep:
        assert wrappers.main_text(page(name)) == "T\n\none\n\ninside\n\ntwo", name
    for name in drop:
        assert wrappers.main_text(page(name)) == "T\n\none\n\ntwo", name


def test_pages_within_a_form_or_a_named_element():
    body = "<h1>T</h1><p>" + "All of the story. " * 20 + "</p>"
    for opening in ('<form id="aspnetForm">', '<div class="main-menu-page">', '<div class="sidebar">', '<div role="form">'):
        close = f"</{opening[1:5].strip('> ')}>".replace("</div ", "</div")
        text = wrappers.main_text(f'<body><nav><a href="/">Home</a></nav>{opening}{body}{close}<div class="comments"><p>I agree</p></div><form>Go</form></body>')
        assert text == "T\n\n" + ("All of the story. " * 20).strip(), opening
    assert wrappers.main_text('<h1>T</h1><p>Short.</p><div class="comments">' + "<p>I agree with all of it</p>" * 9 + "</div>") == "T\n\nShort."


def test_templates_do_not_depend_on_the_order(spark):
    rng = random.Random(2)
    host = "http://o/"

    def page(k):
        blocks = [f"<div class=x{j}><p>Line {j}</p><p>Own {k} {j}</p></div>" for j in range(7) if rng.random() < 0.8]
        return "<div class=top>Site</div>" + "".join(blocks) + "<div class=end><p>Bye</p></div>"

    rows = [(k, f"{host}{k}", page(k)) for k in range(160)]
    seen = set()
    for parts in (1, 5):
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        seen.add(frozenset((r.page_id, r.text) for r in wrappers.extracted(frame).collect()))
    assert len(seen) == 1
    texts = dict(next(iter(seen)))
    html = {k: h for k, _, h in rows}
    for k, t in texts.items():
        # All that is of this page alone, and nothing of the template.
        want = [f"Own {k} {j}" for j in range(7) if f"Own {k} {j}<" in html[k]]
        assert [x for x in t.split("\n\n") if x.startswith("Own")] == want and not {"Site", "Bye"} & set(t.split("\n\n"))


def test_a_page_of_many_blocks_is_quick():
    import time

    began = time.process_time()
    tree, hashes = wrappers.skeleton(wrappers.parse("".join(f"<div class=a{k}><p>x{k}</p></div>" for k in range(1600))))
    t = wrappers.as_template(tree, 9, [{} for _ in hashes])
    assert wrappers.merge(t, wrappers.as_template(tree, 3, [{} for _ in hashes]))[1] == 12 and time.process_time() - began < 4


def test_a_host_of_near_copies_keeps_its_text(spark):
    body = [f"Paragraph {i} of the one article of this host" for i in range(6)]
    near = lambda k: [f"Title {k}", *(f"Changed {k}" if k % 2 and i == k % 6 else p for i, p in enumerate(body)), "Read more"]
    other = lambda k: [f"Other {k}", *(f"Sentence {i} of page {k} alone" for i in range(6)), "Read more"]
    pages = {k: near(k) if k % 10 else other(k) for k in range(40)}
    frame = spark.createDataFrame([(k, f"http://c/{k}", SHELL.format("<article>" + "".join(f"<p>{t}</p>" for t in p) + "</article>")) for k, p in pages.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in wrappers.extracted(frame).collect()}
    assert all(got[k] == (p if k % 10 else p[:-1]) for k, p in pages.items())


@pytest.mark.parametrize("tag", ["div", "span", "font", "p", "li", "td", "article", "nav"])
def test_deeply_nested_pages(tag):
    n = 10_000
    many = f"<{tag}>" * n
    text = {"nav": "x\n\nx", "article": "in"}.get(tag, "x\n\nin\n\nx")
    assert wrappers.main_text("<p>x</p>" + many + "in" + f"</{tag}>" * n + "<p>x</p>") == text
    if tag not in ("nav", "article"):
        assert wrappers.main_text(many + SHELL.format(ARTICLE)) == "A title\n\nFirst & bold\n\nSecond line"
        assert wrappers.main_text(many + "<div>one<div>two</div>three</div><nav>no<div>no</div></nav>four") == "one\n\ntwo\n\nthree\n\nfour"


def test_a_deep_page_beside_others(spark):
    deep = "<div>" * 10_000 + "deep text" + "</div>" * 10_000
    rows = [(k, f"http://d/{k}", f"<div>Site</div><p>Text {k}</p>" if k else deep) for k in range(12)] + [(20 + k, f"http://e/{k}", f"{deep}<p>{k}</p>") for k in range(9)]
    got = {r.page_id: r.text for r in wrappers.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "deep text" and all(got[k] == f"Text {k}" for k in range(1, 12)) and all(got[20 + k].endswith(str(k)) for k in range(9))


def test_language_on_held_out_rows(spark):
    lang = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "lang")
    rows = language.op10_language(spark, LARGER).join(lang, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, monkeypatch):
    schema = "doc_id long, lang string, text string"
    train = [(i, "aa" if i % 2 else "bb", ("la mo ki " if i % 2 else "xu zre wop ") * 5) for i in range(200)]
    odd = [(900, None, None), (901, "aa", "123 !"), (902, None, "la mo ki"), (None, "bb", "xu zre wop"), (903, "aa", ""), (904, None, "mo" * 60_000)]
    frame = spark.createDataFrame(train + odd, schema).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r.lang_pred for r in language.predicted(frame, language.learn(frame), ["doc_id", "score"]).collect()}
    assert (got[900], got[901], got[902], got[None], got[903], got[904]) == ("und", "und", "aa", "bb", "und", "aa")
    kept = language.kept(frame)
    assert kept.columns == frame.columns and kept.count() == 203
    # The stage goes by the model's score.
    scores = {r.doc_id: r.score for r in language.predicted(frame, language.learn(frame), ["doc_id"]).collect() if r.lang_pred != "und"}
    least = sorted(set(scores.values()))[len(set(scores.values())) // 2]
    monkeypatch.setattr(language, "LEAST_SCORE", least)
    assert {r.doc_id for r in language.kept(frame).collect()} == {i for i, x in scores.items() if x >= least}
    monkeypatch.setattr(language, "LEAST_SCORE", 1.01)
    assert language.kept(frame).count() == 0
    monkeypatch.undo()
    none = spark.createDataFrame([(1, None, "some text")], schema)
    assert language.predicted(none, language.learn(none), ["doc_id"]).first().lang_pred == "und"
    assert language.kept(spark.createDataFrame([], schema)).count() == 0


def test_language_stage_without_labels(spark):
    rows = [(1, None, "some text"), (2, None, None), (3, None, "12 !"), (None, None, "漢字"), (5, None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("some", F.lit("clash"))
    left = language.kept(frame)
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {1, None}


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.op8_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.predicted for r in rows) > 0.9 and hit / sum(r.toxic for r in rows) > 0.8


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(i, "good day" if i % 5 else "vile beast") for i in range(400)] + [(1000, None), (1001, ""), (None, "vile beast"), (1, "again"), (1002, "vile " * 40_000)], DOCS).withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(5, None), (7, 9), (None, 1), (77777, 1)], "doc_id long, toxic int")
    rows = toxicity.scores(docs, toxicity.learn(docs, labels)).collect()
    score = {}
    for r in rows:
        score.setdefault(r.doc_id, []).append(r.score)
    assert len(rows) == 405 and score[5][0] > 0.7 > 0.3 > score[3][0] and score[None][0] > 0.7 and score[1000] == score[1001]
    for bad in (spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([(1, 0)], "doc_id long, toxic int")):
        assert {r.score < 0.01 for r in toxicity.scores(docs, toxicity.learn(docs, bad)).collect()} == {True}
    assert toxicity.scores(spark.createDataFrame([], DOCS), toxicity.learn(docs, labels)).count() == 0


def test_pipeline_equals_its_parts(spark):
    """The kept documents and the ids of their cut texts against plain versions of each stage on the smallest table."""
    from tests.llm.test_pairs import words

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    # The first stage is a trained model: what it kept is held against its own scores.
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    told = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(frame, language.learn(frame), ["doc_id"]).collect()}
    kept = {i: t for i, t in docs.items() if told[i][0] != "und" and told[i][1] >= language.LEAST_SCORE}
    assert all(any(c.isalpha() for c in t) for t in kept.values())
    sets = {i: words(t) for i, t in kept.items()}
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    seen, cut = set(), {}
    for i in sorted(i for i in kept if find(i) == i):
        b = kept[i].encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        cut[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    assert sum(cut[i] != kept[i] for i in cut) > 5
    bench = [words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    left = {i: t for i, t in cut.items() if not any(100 * len(s & words(t)) >= 75 * len(s) for s in bench if s)}
    library = Tokenizer.from_file(bpe.tokenizer_path())
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items()}


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_rows(spark, k, tmp_path):
    name, stage = corpus_pipeline.STAGES[k]
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string"
    bench = str(tmp_path)
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{bench}/benchmark.parquet")
    odd = [(i, t, None if (i or 0) % 2 else "en", None, None, None) for i, t in ODD] + [(50, "word " * 30, "en", "s", 3, "x")]
    out = stage(spark, spark.createDataFrame(odd, schema), bench)
    if name != "bpe":
        assert out.columns == [c.split(" ")[0] for c in schema.split(", ")]
    assert out.count() <= len(odd)
    assert stage(spark, spark.createDataFrame([], schema), bench).count() == 0
