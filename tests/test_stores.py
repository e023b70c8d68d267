import sqlite3
import zlib

import pytest
import zstandard

from lexiquarry import sources
from lexiquarry.sources import stores

ARTICLE = "<p>an article of some length, " * 20


def store(version):
    raw = b"an article of some length, <p>" * 4
    known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    frame = zstandard.ZstdCompressor(dict_data=known, write_dict_id=False).compress(ARTICLE.encode())
    deflate = zlib.compressobj(wbits=-15)
    packed = b"\0" + deflate.compress(ARTICLE.encode()) + deflate.flush()
    db = sqlite3.connect(":memory:")
    db.executescript("CREATE TABLE meta(key TEXT PRIMARY KEY, value TEXT); CREATE TABLE entry(id INTEGER PRIMARY KEY, w TEXT NOT NULL, m TEXT NOT NULL); CREATE TABLE alias(w TEXT NOT NULL, entry_id INTEGER NOT NULL);")
    db.execute("INSERT INTO meta VALUES ('name', 'Test'), ('entry_count', NULL)")
    rows = [(1, "plain", "<b>text</b>"), (2, "packed", packed), (3, "broken", b"\0\xff\xff\xff")]
    if version == 2:
        db.execute("CREATE TABLE body_dict(id INTEGER PRIMARY KEY, data BLOB NOT NULL)")
        db.execute("INSERT INTO body_dict VALUES (0, ?)", (raw,))
        rows += [(4, "frame", b"\1" + frame[4:]), (5, "reserved", b"\5xx")]
    db.executemany("INSERT INTO entry VALUES (?, ?, ?)", rows)
    db.execute("INSERT INTO alias VALUES ('Plain', 1), ('nobody', 99), ('PLAIN', 1)")
    db.execute(f"PRAGMA user_version = {version}")
    db.commit()
    return db.serialize()


def test_versions():
    two = {r.headwords[0]: r.body for r in stores.read_store(store(2))}
    assert two == {"plain": "<b>text</b>", "packed": ARTICLE, "broken": "", "frame": ARTICLE, "reserved": ""}
    one = list(stores.read_store(store(1)))
    assert one[0].headwords == ["plain", "Plain", "PLAIN"] and one[1].body == ARTICLE and len(one) == 3
    assert stores.Bodies(1).decode(b"\5xx") == "\5xx" and stores.read_meta(store(1)) == {"name": "Test", "entry_count": ""}
    with pytest.raises(ValueError):
        stores.opened(store(3))


def test_folder_of_stores(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "text.db").write_bytes(store(2))
    rows = sources.records(spark, str(tmp_path))
    assert rows.groupBy("dict_id").count().count() == 2 and rows.filter("problem IS NOT NULL").count() == 0
