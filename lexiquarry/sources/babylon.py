"""Reader of Babylon glossaries (BGL): a gzip stream behind a short head, cut into typed blocks.

A block starts with a byte of type (low half) and size (high half: 4 and more are the size plus 4, less are the number of
bytes that hold it, minus one). Blocks 1, 7, 10, 11 and 13 are entries, 3 holds facts such as character sets, 4 ends the stream."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

from lexiquarry.sources.formats import Record

#: Character sets by their number, from 0x41 on.
CHARSETS = "cp1252 cp1252 cp1250 cp1251 cp932 cp950 cp936 cp1257 cp1253 cp949 cp1254 cp1255 cp1256 cp874".split()
#: Facts that name the character sets of headwords and of articles, and the default.
SOURCE_SET, TARGET_SET, DEFAULT_SET = 0x1A, 0x1B, 8
#: Bytes that a glossary may unpack to.
MOST = 4 << 30

_ZONE = re.compile(rb'<charset\s+c="?([A-Za-z])"?>(.*?)</charset>', re.S | re.I)


def blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    if data[:4] not in (b"\x12\x34\x00\x01", b"\x12\x34\x00\x02"):
        raise ValueError("not a glossary")
    at = int.from_bytes(data[4:6], "big")
    unpack = zlib.decompressobj(31)
    text = unpack.decompress(data[at:], MOST)
    if unpack.unconsumed_tail:
        raise ValueError("a glossary above the bound")
    p = 0
    while p < len(text):
        kind, n = text[p] & 15, text[p] >> 4
        p += 1
        if n < 4:
            size = int.from_bytes(text[p : p + n + 1], "big")
            p += n + 1
        else:
            size = n - 4
        if kind == 4 or p + size > len(text):
            return
        yield kind, text[p : p + size]
        p += size


def _charset(number: int) -> str:
    k = number - 0x41
    return CHARSETS[k] if 0 <= k < len(CHARSETS) else "cp1252"


def decoded(raw: bytes, charset: str, other: str) -> str:
    """Text of a field: zones name their own character set, or list code points."""
    out, at = [], 0
    for m in _ZONE.finditer(raw):
        out.append(raw[at : m.start()].decode(charset, "replace"))
        kind, own = m[1].upper(), m[2]
        if kind == b"T":
            out += [chr(c) for x in own.split(b";") if re.fullmatch(rb"\s*[0-9A-Fa-f]{1,6}\s*", x) and (c := int(x, 16)) < 0x110000]
        else:
            out.append(own.decode({b"U": "utf-8", b"G": "gb18030", b"K": other, b"E": other}.get(kind, charset), "replace"))
        at = m.end()
    out.append(raw[at:].decode(charset, "replace"))
    return "".join(out)


def _fields(kind: int, body: bytes) -> tuple[bytes, bytes, list[bytes]] | None:
    """Headword, article and other headwords of an entry; None if it is cut short."""
    p = 0

    def part(width: int) -> bytes:
        nonlocal p
        n = int.from_bytes(body[p : p + width], "big")
        own = body[p + width : p + width + n]
        p += width + n
        if p > len(body) or len(own) < n:
            raise EOFError
        return own

    try:
        if kind == 11:
            word = part(5)
            count = int.from_bytes(body[p : p + 4], "big")
            p += 4
            others = [part(4) for _ in range(count)]
            return word, part(4), others
        word, article, others = part(1), part(2), []
        while p < len(body):
            others.append(part(1))
        return word, article, others
    except EOFError:
        return None


def _word(text: str) -> str:
    """A headword without markup and without the number that some glossaries add between dollar signs."""
    return re.sub(r"\$\d+\$$", "", html.unescape(re.sub(r"<[^>]*>", "", text)).strip()).strip()


def read_bgl(data: bytes) -> Iterator[Record]:
    """Entries in order; a headword is its own first name, others follow, each once; an article ends where its attributes begin."""
    source = target = "cp1252"
    for kind, body in blocks(data):
        if kind == 0 and len(body) > 1 and body[0] == DEFAULT_SET:
            source = target = _charset(body[1])
        elif kind == 3 and len(body) > 2:
            fact, value = int.from_bytes(body[:2], "big"), body[2:]
            if fact == SOURCE_SET:
                source = _charset(value[0])
            elif fact == TARGET_SET:
                target = _charset(value[0])
        elif kind in (1, 7, 10, 11, 13) and (found := _fields(kind, body)):
            word, article, others = found
            names = dict.fromkeys(n for raw in (word, *others) if (n := _word(decoded(raw, source, target))))
            text = decoded(article.split(b"\x14", 1)[0], target, source).strip("\0\r\n ")
            if names and text:
                yield Record(list(names), text, "html")
