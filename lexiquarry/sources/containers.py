"""Readers of two container formats: archives of web pages (ZIM) and keyed record blocks (MDX).

Sizes in a file are checked before they are used; a record or cluster that cannot be read is skipped."""

from __future__ import annotations

import html
import lzma
import re
import struct
import zlib
from collections.abc import Iterator

from lexiquarry.sources.formats import Record, style_sheet, styled

#: A unit (cluster, block) may unpack to this much; above, the file is taken to be broken.
MOST_UNIT = 1 << 28


def _zlib(data: bytes) -> bytes:
    d = zlib.decompressobj()
    out = d.decompress(data, MOST_UNIT)
    if d.unconsumed_tail:
        raise ValueError("a unit is too large")
    return out


def _zstd(data: bytes) -> bytes:
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(data) as r:
        out = r.read(MOST_UNIT + 1)
    if len(out) > MOST_UNIT:
        raise ValueError("a unit is too large")
    return out


def _xz(data: bytes) -> bytes:
    out = lzma.LZMADecompressor(memlimit=1 << 28).decompress(data, MOST_UNIT)
    return out


def _text(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    return data[at:end].decode("utf-8", "replace"), end + 1


def article_body(page: str) -> str:
    """The inside of a page's body, with its style sheet links before it."""
    head = re.search(r"(?is)<head[^>]*>(.*?)</head>", page)
    sheets = "".join(re.findall(r"(?is)<link[^>]*stylesheet[^>]*>", head[1])) if head else ""
    body = re.search(r"(?is)<body[^>]*>(.*)</body>", page)
    return sheets + (body[1] if body else page)


def read_zim(data: bytes) -> Iterator[Record]:
    """HTML articles in order of cluster and blob, with the titles that redirect to them as aliases."""
    if struct.unpack("<I", data[:4])[0] != 0x044D495A:
        raise ValueError("not a ZIM file")
    entries, clusters, urls, _, cluster_at, mimes_at = struct.unpack("<IIQQQQ", data[24:64])
    mimes, at = [], mimes_at
    while True:
        name, at = _text(data, at)
        if not name:
            break
        mimes.append(name)
    articles: dict[int, tuple[int, int, str]] = {}
    links: dict[int, list[str]] = {}
    redirect: dict[int, tuple[int, str]] = {}
    for i in range(entries):
        p = struct.unpack("<Q", data[urls + 8 * i : urls + 8 * i + 8])[0]
        mime, _, space = struct.unpack("<HBc", data[p : p + 4])
        if mime == 0xFFFF:
            target = struct.unpack("<I", data[p + 8 : p + 12])[0]
            url, q = _text(data, p + 12)
            redirect[i] = target, _text(data, q)[0] or url
        elif space in (b"A", b"C") and mime < len(mimes) and mimes[mime].startswith(("text/html", "application/xhtml")):
            cluster, blob = struct.unpack("<II", data[p + 8 : p + 16])
            url, q = _text(data, p + 16)
            articles[i] = cluster, blob, _text(data, q)[0] or url
    for i, (target, title) in redirect.items():
        seen = {i}
        while target in redirect and target not in seen:
            seen.add(target)
            target = redirect[target][0]
        if target in articles:
            links.setdefault(target, []).append(title)
    held, parts = -1, []
    for i, (cluster, blob, title) in sorted(articles.items(), key=lambda x: (x[1][:2], x[0])):
        if cluster != held and cluster < clusters:
            held = cluster
            try:
                parts = _cluster(data, cluster_at, cluster, clusters)
            except (ValueError, lzma.LZMAError, zlib.error, struct.error, RuntimeError):
                parts = []
        body = article_body(parts[blob].decode("utf-8", "replace")) if blob < len(parts) else ""
        if body.strip():
            yield Record([title, *sorted(set(links.get(i, [])) - {title})], body)


def _cluster(data: bytes, table: int, k: int, count: int) -> list[bytes]:
    start = struct.unpack("<Q", data[table + 8 * k : table + 8 * k + 8])[0]
    following = [struct.unpack("<Q", data[table + 8 * j : table + 8 * j + 8])[0] for j in range(count)]
    end = min((f for f in following if f > start), default=len(data))
    info = data[start]
    raw = data[start + 1 : end]
    raw = {0: bytes, 1: bytes, 4: _xz, 5: _zstd}[info & 15](raw)
    width, form = (8, "Q") if info & 16 else (4, "I")
    first = struct.unpack(f"<{form}", raw[:width])[0]
    offsets = struct.unpack(f"<{first // width}{form}", raw[:first])
    return [raw[a:b] for a, b in zip(offsets, offsets[1:])]


def _block(data: bytes) -> bytes:
    kind = data[:4]
    if kind == b"\0\0\0\0":
        return data[8:]
    if kind == b"\2\0\0\0":
        return _zlib(data[8:])
    raise ValueError(f"blocks of kind {kind[0]} are not read")


def read_mdx(data: bytes) -> Iterator[Record]:
    """Keys and records of a version 1.2 or 2 file; a record of only a link is a redirect, one to itself is dropped."""
    size = struct.unpack(">I", data[:4])[0]
    head = data[4 : 4 + size].decode("utf-16-le", "replace")
    info = {k: html.unescape(v) for k, v in re.findall(r'(\w+)="(.*?)"', head, re.S)}
    if info.get("Encrypted", "0") not in ("0", "No", ""):
        raise ValueError("an encrypted file")
    new = float(info.get("GeneratedByEngineVersion", "2.0")) >= 2
    codec = {"": "utf-8", "UTF-16": "utf-16-le", "GBK": "gb18030"}.get(info.get("Encoding", ""), info.get("Encoding", "utf-8").lower())
    unit = 2 if codec == "utf-16-le" else 1
    width, form = (8, "Q") if new else (4, "I")
    at = 8 + size

    def numbers(n: int) -> tuple:
        nonlocal at
        out = struct.unpack(f">{n}{form}", data[at : at + n * width])
        at += n * width
        return out

    blocks, _, *lengths = numbers(5 if new else 4)
    index_size, keys_size = lengths[-2:]
    at += 4 if new else 0
    index = _block(data[at : at + index_size]) if new else data[at : at + index_size]
    at += index_size
    sizes, p = [], 0
    for _ in range(blocks):
        p += width
        for _ in range(2):
            n = struct.unpack(">H", index[p : p + 2])[0] if new else index[p]
            p += (2 if new else 1) + (n + (1 if new else 0)) * unit
        sizes.append(struct.unpack(f">{form}", index[p : p + width])[0])
        p += 2 * width
    keys: list[tuple[int, str]] = []
    end_mark = b"\0" * unit
    for n in sizes:
        own, q = _block(data[at : at + n]), 0
        at += n
        while q + width < len(own):
            offset = struct.unpack(f">{form}", own[q : q + width])[0]
            stop = q + width
            while own[stop : stop + unit] not in (end_mark, b""):
                stop += unit
            keys.append((offset, own[q + width : stop].decode(codec, "replace")))
            q = stop + unit
    blocks, _, index_size, _ = numbers(4)
    sizes = [numbers(2) for _ in range(blocks)]
    text = bytearray()
    for packed, full in sizes:
        try:
            text += _block(data[at : at + packed])
        except (ValueError, zlib.error):
            text += b"\0" * full
        at += packed
    styles = style_sheet(info.get("StyleSheet", ""))
    ends = [o for o, _ in keys[1:]] + [len(text)]
    for (start, word), stop in zip(keys, ends):
        body = bytes(text[start:stop]).decode(codec, "replace").strip("\0\r\n ")
        seen = re.sub(r"<[^>]*>", "", body).strip()
        link = html.unescape(seen[8:]).strip() if seen.startswith("@@@LINK=") else ""
        if word.strip() and body and link != word:
            yield Record([word], "" if link else styled(body, styles) if styles or "`" in body else body, "html", link)
