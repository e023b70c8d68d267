import lzma
import struct
import zlib

import pytest

from lexiquarry.sources import containers


def zim(pack, kind):
    pages = [b"<html><head><link rel='stylesheet' href='s.css'></head><body>one</body></html>", b"<p>two</p>", b" "]
    table = 4 * (len(pages) + 1)
    offsets = [table + sum(map(len, pages[:i])) for i in range(len(pages) + 1)]
    cluster = bytes([kind]) + pack(struct.pack(f"<{len(offsets)}I", *offsets) + b"".join(pages))
    content = lambda blob, url, title, mime=0: struct.pack("<HBcIII", mime, 0, b"C", 0, 0, blob) + url + b"\0" + title + b"\0"
    link = lambda to, url: struct.pack("<HBcII", 0xFFFF, 0, b"C", 0, to) + url + b"\0\0"
    dirents = [content(1, b"b", b"Bee"), content(0, b"a", b""), link(1, b"alpha"), link(2, b"far"), content(2, b"e", b"Empty"), content(0, b"pic", b"", 1), link(6, b"loop")]
    mimes = b"text/html\0image/png\0\0"
    at = 80 + len(mimes)
    pointers = [at + sum(map(len, dirents[:i])) for i in range(len(dirents))]
    urls = at + sum(map(len, dirents))
    clusters = urls + 8 * len(dirents)
    head = struct.pack("<IHH16sIIQQQQIIQ", 0x044D495A, 6, 1, b"u" * 16, len(dirents), 1, urls, urls, clusters, 80, 0, 0, 0)
    return head + mimes + b"".join(dirents) + struct.pack(f"<{len(pointers)}Q", *pointers) + struct.pack("<Q", clusters + 8) + cluster


def zstd(data):
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


@pytest.mark.parametrize("pack, kind", [(bytes, 1), (zstd, 5), (lambda d: lzma.compress(d, lzma.FORMAT_XZ), 4)])
def test_zim(pack, kind):
    got = [(r.headwords, r.body) for r in containers.read_zim(zim(pack, kind))]
    assert got == [(["a", "alpha", "far"], "<link rel='stylesheet' href='s.css'>one"), (["Bee"], "<p>two</p>")]
    with pytest.raises(ValueError):
        list(containers.read_zim(b"x" * 80))


def mdx(new, codec, encoding):
    words = [("alpha", "<p>first</p>"), ("beta", "@@@LINK=alpha\r\n"), ("self", "@@@LINK=self"), ("zeta", "last")]
    form, unit = (">Q", 2 if codec == "utf-16-le" else 1) if new else (">I", 2 if codec == "utf-16-le" else 1)
    pack = lambda d: b"\2\0\0\0" + struct.pack(">I", zlib.adler32(d)) + zlib.compress(d)
    n = lambda *x: b"".join(struct.pack(form, v) for v in x)
    records, offsets, at = b"", [], 0
    for _, b in words:
        offsets.append(len(records))
        records += b.encode(codec) + b"\0" * unit
    keys = b"".join(n(o) + w.encode(codec) + b"\0" * unit for o, (w, _) in zip(offsets, words))
    key_block = pack(keys)
    edge = lambda w: (struct.pack(">H", len(w)) + w.encode(codec) + b"\0" * unit) if new else bytes([len(w)]) + w.encode(codec)
    index = n(len(words)) + edge("alpha") + edge("zeta") + n(len(key_block), len(keys))
    packed = pack(index) if new else index
    head = f'<Dictionary GeneratedByEngineVersion="{"2.0" if new else "1.2"}" Encrypted="No" Encoding="{encoding}" Title="T"/>'.encode("utf-16-le")
    numbers = n(1, len(words), len(index), len(packed), len(key_block)) + b"\0" * 4 if new else n(1, len(words), len(packed), len(key_block))
    block = pack(records)
    return struct.pack(">I", len(head)) + head + b"\0" * 4 + numbers + packed + key_block + n(1, len(words), 16 if new else 8, len(block)) + n(len(block), len(records)) + block


@pytest.mark.parametrize("new", [True, False])
@pytest.mark.parametrize("codec, encoding", [("utf-8", "UTF-8"), ("utf-16-le", "UTF-16")])
def test_mdx(new, codec, encoding):
    got = [(r.headwords, r.body, r.link_to) for r in containers.read_mdx(mdx(new, codec, encoding))]
    assert got == [(["alpha"], "<p>first</p>", ""), (["beta"], "", "alpha"), (["zeta"], "last", "")]


def bgl():
    import gzip

    def block(kind, body):
        return bytes([kind | (len(body) + 4) << 4]) + body if len(body) < 12 else bytes([kind | 1 << 4]) + len(body).to_bytes(2, "big") + body

    def entry(word, article, *others):
        return bytes([len(word)]) + word + len(article).to_bytes(2, "big") + article + b"".join(bytes([len(o)]) + o for o in others)

    long = b"\0\0\0\0\3big" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big") + b"lg" + (4).to_bytes(4, "big") + b"size"
    text = block(0, b"\x08\x41") + block(3, b"\0\x1a\x44") + block(3, b"\0\x1b\x44")
    text += block(1, entry("кот$12$".encode("cp1251"), "<b>cat</b> <charset c=T>00E9;4E00;</charset>\x14\x02\x30".encode("cp1251"), b"kot", "кот".encode("cp1251")))
    text += block(1, b"\x09short") + block(11, long) + block(2, b"picture") + block(4, b"") + block(1, entry(b"after", b"the end"))
    return b"\x12\x34\x00\x02\x00\x0a" + b"\0" * 4 + gzip.compress(text)


def test_bgl():
    from lexiquarry.sources import babylon

    assert [(r.headwords, r.body) for r in babylon.read_bgl(bgl())] == [(["кот", "kot"], "<b>cat</b> é一"), (["big", "lg"], "size")]
    assert list(babylon.read_bgl(bgl()[:-9]))[:1] == list(babylon.read_bgl(bgl()))[:1]
    with pytest.raises(ValueError):
        list(babylon.read_bgl(b"x" * 40))
