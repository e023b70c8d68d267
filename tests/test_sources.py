import gzip
import struct
import zlib

import pytest

from lexiquarry import sources
from lexiquarry.api import Library, parse_mode
from lexiquarry.sources import formats as rec
from lexiquarry.sources import readers


@pytest.mark.parametrize(
    "name, kind, form", [("a.dict.md", "main", "markdown"), ("a.md", "other", ""), ("x_abrv.dsl", "companion", "dsl"), ("x.DSL.dz", "main", "dsl"), ("x.dict.dz", "companion", "stardict"), ("x.zip", "candidate", ""), ("x.dsl.files.zip", "companion", "dsl")]
)
def test_names(name, kind, form):
    assert rec.classify(name) == (kind, form)


def test_titles():
    assert rec.expand_title("colo(u)r") == ["colour", "color"]
    assert rec.expand_title("a{ix}b {{note}}c") == ["ab c"]
    assert len(rec.expand_title("".join(f"({c})" for c in "abcdefg"))) == 1
    assert rec.expand_title(r"a\(b\)") == ["a(b)"]


def test_readers_of_bytes():
    csv = list(rec.read_csv(b"#name,Test\nword,<b>x</b>,\"alt one, alt two\"\nword (2),plain\n,nameless\n"))
    assert [(r.headwords, r.kind) for r in csv] == [(["word", "alt one", "alt two"], "html"), (["word"], "text")]
    dsl = list(rec.read_dsl("#NAME \"x\"\ncat\ndog\n\t[b]animal[/b] <<bird>>\n\t@ sub\n\tinside\nfox\n\tred\n".encode("utf-16")))
    assert [r.headwords for r in dsl] == [["@sub"], ["cat", "dog"], ["fox"]]
    assert dsl[1].body == '<b>animal</b> <a href="entry://bird">bird</a><br/><a href="entry://@sub">@sub</a>'
    md = list(rec.read_markdown(b"# Title\n## one\n## uno\nfirst\n## two\nsee: one\n"))
    assert [(r.headwords, r.body, r.link_to) for r in md] == [(["one", "uno"], "first", ""), (["two"], "", "one")]
    assert rec.link_target("<html>@@@LINK=a &amp; b\r\n</html>") == "a & b" and rec.link_target("x @@@LINK=a") == ""


def stardict():
    body = b"first\0" + b"second"
    index = b"a\0" + struct.pack(">II", 0, 5) + b"b\0" + struct.pack(">II", 6, 6) + b"bad\0" + struct.pack(">II", 900, 6)
    return b"StarDict's dict ifo file\nbookname=T\nsametypesequence=m\n", gzip.compress(index), gzip.compress(body), b"bee\0" + struct.pack(">I", 1)


def slob():
    text = lambda s, n: len(s).to_bytes(n, "big") + s
    items = b"".join(struct.pack(">I", len(x)) + x for x in (b"<p>one</p>", b"\x89PNG"))
    raw = struct.pack(">II", 0, 14) + items
    packed = zlib.compress(raw)
    store = struct.pack(">I", 1) + struct.pack(">Q", 0) + struct.pack(">I", 2) + b"\0\1" + struct.pack(">I", len(packed)) + packed
    refs = [text(k, 2) + struct.pack(">IH", 0, i) + b"\0" for k, i in ((b"one", 0), (b"uno", 0), (b"pic", 1))]
    offsets = [sum(map(len, refs[:i])) for i in range(3)]
    refs = struct.pack(">I", 3) + b"".join(struct.pack(">Q", o) for o in offsets) + b"".join(refs)
    head = b"!-1SLOB\x1f" + b"u" * 16 + text(b"utf-8", 1) + text(b"zlib", 1) + b"\1" + text(b"label", 1) + text(b"x", 1) + b"\2" + text(b"text/html", 2) + text(b"image/png", 2) + struct.pack(">I", 2)
    return head + struct.pack(">QQ", len(head) + 16 + len(refs), 0) + refs + store


def test_slob():
    assert [(r.headwords, r.body) for r in rec.read_slob(slob())] == [(["one", "uno"], "<p>one</p>")]


def test_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    for suffix, data in zip((".ifo", ".idx.gz", ".dict.dz", ".syn"), stardict()):
        (tmp_path / "sub" / f"t{suffix}").write_bytes(data)
    (tmp_path / "w.dict.md").write_text("## alpha\n## Álpha\ntext of alpha\n## beta\n<b>beta</b> and alpha\n## gamma\nsee: ALPHA\n")
    (tmp_path / "s.slob").write_bytes(slob())
    (tmp_path / "broken.slob").write_bytes(b"no")
    (tmp_path / ".hidden" / "h.csv").write_text("a,b\n")
    (tmp_path / "notes.txt").write_text("no")
    found = sources.records(spark, str(tmp_path)).cache()
    assert found.filter("problem IS NOT NULL").count() == 1
    assert sources.dictionaries(spark, str(tmp_path)).count() == 4
    star = {tuple(r.headwords): r.body for r in found.collect() if r.dict_id.endswith("/t")}
    assert star == {("a",): "<p>first</p>", ("b", "bee"): "<p>second</p>"}
    own = Library.of_records(found.filter("problem IS NULL"))
    assert [r.key for r in own.search("gamma", "exact").collect()] == ["gamma"]
    assert own.suggest("al") == ["alpha", "Álpha"] or own.suggest("al")[0] == "alpha"
    hits = own.search("alpha", "fts", marks=True).collect()
    assert {r.headword for r in hits} == {"alpha", "beta"} and all('<mark class="wu-hl">alpha</mark>' in r.body for r in hits)
    own.write(str(tmp_path / "store"))
    again = Library.open(spark, str(tmp_path / "store"))
    assert again.search("be").count() == own.search("be").count() > 0
    assert len(list(own.stream(own.search("b*", "wildcard")))) == own.search("b*", "wildcard").count()
    assert own.search("a" * 80, "wildcard").count() == 0 and own.search('"', "fts").count() == 0


def test_modes():
    assert [parse_mode(m) for m in (None, "fuzzy", "FTS", "exact", "bad")] == ["prefix", "prefix", "fts", "exact", "prefix"]


def test_large_files_are_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MOST_BYTES", 200)
    info, index, body, _ = stardict()
    for name, content in {"s.ifo": info, "s.idx.gz": index, "s.dict": gzip.decompress(body) + b"x" * 200, "big.csv": b"a,b\n" * 100, "small.csv": b"word,plain\n", "small.mdd": b"x" * 201, "other.bin": b"x" * 201}.items():
        (tmp_path / name).write_bytes(content)
    rows = sources.records(spark, str(tmp_path)).collect()
    assert [r.headwords for r in rows if r.problem is None] == [["word"]]
    assert sorted(r.problem.split(":")[0] for r in rows if r.problem) == ["big.csv", "s.dict", "s.ifo", "small.mdd"]
