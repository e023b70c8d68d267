"""Parsers of dictionary formats: bytes to records (headwords, body, kind, link_to)."""

from __future__ import annotations

import bz2
import csv
import gzip
import html
import io
import itertools
import json
import lzma
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

#: File-name suffixes and the format that they stand for; the longest one decides.
MAIN = {".csv": "csv", ".tsv": "csv", ".json": "json", ".ifo": "stardict", ".dsl": "dsl", ".dsl.dz": "dsl", ".dict.md": "markdown", ".slob": "slob", ".mdx": "mdx", ".zim": "zim", ".zimaa": "zim", ".zimaa": "zim", ".bgl": "bgl", "text.db": "store"}
COMPANION = {".idx": "stardict", ".idx.gz": "stardict", ".dict": "stardict", ".dict.dz": "stardict", ".syn": "stardict", ".mdd": "mdx", "_abrv.dsl": "dsl", "_abrv.dsl.dz": "dsl", ".ann": "dsl", ".dsl.files.zip": "dsl", ".res.zip": "stardict"}
CANDIDATE = {".zip", ".7z", ".tar.gz", ".gz"}


@dataclass
class Record:
    headwords: list[str]
    body: str
    kind: str = "html"
    link_to: str = ""


#: The parts of a split archive after its first.
PART = re.compile(r"\.zim(?!aa)[a-z]{2}$", re.I)


def classify(name: str) -> tuple[str, str]:
    """(main, companion, candidate or other; format) of a file name, by its longest known suffix."""
    low = name.lower()
    if PART.search(low):
        return "companion", "zim"
    found = [(len(s), "main", f) for s, f in MAIN.items() if low.endswith(s)]
    found += [(len(s), "companion", f) for s, f in COMPANION.items() if low.endswith(s)]
    found += [(len(s), "candidate", "") for s in CANDIDATE if low.endswith(s)]
    return max(found)[1:] if found else ("other", "")


def stem(name: str) -> str:
    """The file name without its main suffix."""
    low = name.lower()
    if PART.search(low):
        return name[:-6]
    own = max((s for s in [*MAIN, *COMPANION] if low.endswith(s)), key=len, default="")
    return name[: len(name) - len(own)] if own else name.rsplit(".", 1)[0]


def decoded(data: bytes) -> str:
    """Text of a file by its byte-order mark, else UTF-16 where every other byte is zero, else UTF-8 or Windows-1252."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(codec, "replace")
    head = data[:4096]
    if len(head) > 3 and head[1::2].count(0) > len(head) // 4:
        return data.decode("utf-16-le", "replace")
    if len(head) > 3 and head[::2].count(0) > len(head) // 4:
        return data.decode("utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


_NUMBERED = re.compile(r"\s\(\d+\)$")


def read_csv(data: bytes, numbered: bool = True) -> Iterator[Record]:
    """word, body and comma-joined alternates; #key rows are information. ``term (2)`` is another record of term."""
    text = decoded(data)
    delimiter = "\t" if "\t" in text.split("\n", 1)[0] else ","
    for row in csv.reader(io.StringIO(text), delimiter=delimiter):
        if not row or row[0].startswith("#") or not row[0].strip():
            continue
        word = _NUMBERED.sub("", row[0]) if numbered else row[0]
        alternates = [a.strip() for a in (row[2] if len(row) > 2 else "").split(",") if a.strip()]
        body = row[1] if len(row) > 1 else ""
        yield Record([word, *alternates], body, "html" if re.search(r"<[a-zA-Z]", body) else "text")


def read_json(data: bytes) -> Iterator[Record]:
    """An object of words to bodies, or a list of records with word, body and alternates joined by bars."""
    found = json.loads(decoded(data))
    rows = [{"word": k, "body": v} for k, v in found.items()] if isinstance(found, dict) else found
    for r in rows:
        words = [w.strip() for w in str(r.get("word", "")).split("|")] + [w.strip() for w in r.get("alternates", [])]
        words = [w for w in words if w]
        if words:
            yield Record(words, str(r.get("body", "")), r.get("kind", "html"))


def stardict_info(data: bytes) -> dict[str, str]:
    return dict(line.split("=", 1) for line in decoded(data).splitlines() if "=" in line)


def read_stardict(info: dict[str, str], index: bytes, body: bytes, synonyms: bytes = b"") -> Iterator[Record]:
    """Entries of an index over its articles; synonyms are further headwords; what cannot be read is skipped."""
    if index[:2] == b"\x1f\x8b":
        index = gzip.decompress(index)
    if body[:2] == b"\x1f\x8b":
        body = gzip.decompress(body)
    wide = info.get("idxoffsetbits") == "64"
    step, form = (12, ">QI") if wide else (8, ">II")
    more: dict[int, list[str]] = {}
    at = 0
    while (end := synonyms.find(b"\0", at)) >= 0 and end + 5 <= len(synonyms):
        more.setdefault(struct.unpack(">I", synonyms[end + 1 : end + 5])[0], []).append(synonyms[at:end].decode("utf-8", "replace"))
        at = end + 5
    at, k = 0, 0
    while (end := index.find(b"\0", at)) >= 0 and end + 1 + step <= len(index):
        offset, size = struct.unpack(form, index[end + 1 : end + 1 + step])
        if offset + size <= len(body):
            yield Record([index[at:end].decode("utf-8", "replace"), *more.get(k, [])], stardict_body(body[offset : offset + size], info.get("sametypesequence", "")))
        at, k = end + 1 + step, k + 1


def stardict_body(raw: bytes, types: str) -> str:
    """HTML of a typed article: h and g as they are, m, l, t and y as text, x with its tags made HTML; others dropped."""
    parts: list[tuple[str, bytes]] = []
    if types:
        for i, t in enumerate(types):
            last = i == len(types) - 1
            if t.isupper():
                size = len(raw) if last else struct.unpack(">I", raw[:4])[0]
                own, raw = (raw, b"") if last else (raw[4 : 4 + size], raw[4 + size :])
            else:
                own, _, raw = (raw, b"", b"") if last else raw.partition(b"\0")
            parts.append((t, own))
    else:
        while raw:
            t, raw = chr(raw[0]), raw[1:]
            if t.isupper():
                size = struct.unpack(">I", raw[:4])[0] if len(raw) >= 4 else 0
                own, raw = raw[4 : 4 + size], raw[4 + size :]
            else:
                own, _, raw = raw.partition(b"\0")
            parts.append((t, own))
    out = []
    for t, own in parts:
        text = own.decode("utf-8", "replace")
        if t in "hg":
            out.append(text)
        elif t in "mlty":
            out.append("<p>" + escaped(text).replace("\n", "<br/>") + "</p>")
        elif t == "x":
            out.append(xdxf_html(text))
    return "".join(out)


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


#: Dictionary-exchange elements and what they are in HTML.
XDXF = {"k": "b", "b": "b", "i": "i", "tr": "span", "c": "span", "ex": "i", "co": "i", "abr": "i", "dtrn": "span", "su": "div", "def": "div", "sub": "sub", "sup": "sup"}


def xdxf_html(text: str) -> str:
    text = re.sub(r"<kref>(.*?)</kref>", lambda m: f'<a href="entry://{m[1]}">{m[1]}</a>', text, flags=re.S)
    text = re.sub(r"<(/?)(\w+)[^>]*>", lambda m: m[0] if m[2] == "a" else f"<{m[1]}{XDXF[m[2]]}>" if m[2] in XDXF else "", text)
    return text.replace("\n", "<br/>")


def expand_title(title: str) -> list[str]:
    """Keys of a card title: parentheses are optional parts (all choices up to six of them, else with and without
    all), braces are unsorted parts and stay out of keys, double braces are comments, a backslash quotes."""
    title = re.sub(r"\{\{.*?\}\}", "", title)
    title = re.sub(r"(?<!\\)\{(.*?)(?<!\\)\}", "", title)
    parts = re.split(r"(?<!\\)\((.*?)(?<!\\)\)", title)
    fixed, optional = parts[::2], parts[1::2]
    choices = itertools.product((True, False), repeat=len(optional)) if len(optional) <= 6 else [(True,) * len(optional), (False,) * len(optional)]
    out = []
    for pick in choices:
        own = fixed[0] + "".join((o if p else "") + f for o, p, f in zip(optional, pick, fixed[1:]))
        own = " ".join(re.sub(r"\\(.)", r"\1", own).split())
        if own and own not in out:
            out.append(own)
    return out


_STYLE = re.compile(r"`(\d+)`")


def styled(text: str, styles: dict[int, tuple[str, str]]) -> str:
    """Style tokens as the beginning and end that their number stands for, up to the next token; text before the first is of
    style 0, and numbers without a style leave their text bare."""
    parts = _STYLE.split(text)
    numbers = [0, *(int(n) if len(n) < 10 else -1 for n in parts[1::2])]
    stretches = list(zip(numbers, parts[::2]))
    # Nothing follows a token at the very end.
    if len(stretches) > 1 and not stretches[-1][1]:
        stretches.pop()
    return "".join(styles.get(n, ("", ""))[0] + t + styles.get(n, ("", ""))[1] for n, t in stretches)


def style_sheet(text: str) -> dict[int, tuple[str, str]]:
    """Numbered styles of a file head: three lines each, number, beginning and end."""
    lines = re.split(r"\r\n?|\n", text)
    return {int(n): (a, b) for n, a, b in zip(lines[::3], lines[1::3], [*lines[2::3], ""]) if n.strip().isdigit() and int(n) < 256}


#: Languages that card markup names in its own way, and its older numbers.
DSL_NAMES = {"armenianwestern": "hyw", "azericyrillic": "az-Cyrl", "azerilatin": "az-Latn", "chineseprc": "zh-Hans", "kirgiz": "ky", "norwegianbokmal": "nb", "norwegiannynorsk": "nn", "serbiancyrillic": "sr-Cyrl", "serbianlatin": "sr-Latn", "uzbekcyrillic": "uz-Cyrl", "uzbeklatin": "uz-Latn"}
DSL_NUMBERS = {1: "en", 2: "ru", 3: "de", 4: "fr", 5: "it", 6: "es", 7: "es", 8: "pt", 9: "eu", 10: "nl", 11: "fi", 12: "sv", 13: "da", 14: "nb", 15: "af", 16: "id", 17: "sw", 18: "cs", 19: "hu", 20: "pl", 21: "be", 22: "bg", 23: "sr-Cyrl", 24: "uk", 25: "nn", 26: "de", 27: "tr", 28: "zh-Hans", 29: "zh-Hant", 30: "la"}


def dsl_language(attributes: str) -> str:
    """The HTML attributes of a language zone: what its author wrote, and the language that this means."""
    from lexiquarry.operators.direct import PRIMARY, WHOLE
    from lexiquarry.operators.languages import CODES

    found = re.search(r'\b(name|id)\s*=\s*"?([^"\]]+?)"?\s*$', attributes)
    if not found:
        return ""
    raw = found[2].strip()
    if found[1] == "name":
        low = raw.lower()
        tag = DSL_NAMES.get(low) or CODES.get(low) or next((CODES[n] for n in sorted((c for c in CODES if len(c) > 3), key=lambda n: (-len(n), n)) if low.startswith(n)), "")
    else:
        n = int(raw) if raw.isdigit() else 0
        tag = DSL_NUMBERS.get(n) or (WHOLE.get(n) or PRIMARY.get(n & 1023, "") if n else "")
    return f' data-lang="{html.escape(raw)}"' + (f' lang="{tag}"' if tag else "")


#: Card markup and its HTML.
DSL_TAGS = {"b": "b", "i": "i", "u": "u", "sub": "sub", "sup": "sup", "ex": "span", "com": "span", "trn": "span", "c": "span", "p": "i", "m": "div", "'": "u", "*": "span", "t": "span", "lang": "span"}


def dsl_html(text: str) -> str:
    text = re.sub(r"\{\{.*?\}\}", "", text, flags=re.S)
    text = re.sub(r"<<(.*?)>>|\[ref[^\]]*\](.*?)\[/ref\]", lambda m: f"\1{m[1] or m[2]}\2", text)
    text = re.sub(r"\[s\](.*?)\[/s\]", lambda m: f"\3{m[1]}\4", text)
    text = escaped(text)
    text = re.sub(r"(?<!\\)\[(/?)(\w+|['*])([^\]]*)\]", lambda m: (f"<{m[1]}{DSL_TAGS[t]}{dsl_language(html.unescape(m[3])) if t == 'lang' and not m[1] else ''}>" if (t := re.sub(r"\d+$", "", m[2])) in DSL_TAGS else ""), text)
    text = re.sub("\1(.*?)\2", lambda m: f'<a href="entry://{m[1]}">{m[1]}</a>', text)
    text = re.sub("\3(.*?)\4", lambda m: f'<img src="{m[1]}">', text)
    return re.sub(r"\\(.)", r"\1", text)


_INCLUDE = re.compile(r'#INCLUDE\s+"([^"]+)"', re.I)


def dsl_includes(data: bytes) -> list[str]:
    """The names of the files that a card file includes."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    lines = decoded(data).splitlines()
    return [m[1].replace("\\", "/").rsplit("/", 1)[-1] for x in lines if x.startswith("#") and (m := _INCLUDE.match(x))]


def dsl_lines(data: bytes, others: dict[str, bytes], seen: frozenset = frozenset()) -> Iterator[str]:
    """Lines of a card file, those of the files it includes in place of the directive; a file within itself counts once."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    for line in decoded(data).splitlines():
        found = _INCLUDE.match(line)
        name = found[1].replace("\\", "/").rsplit("/", 1)[-1].lower() if found else ""
        if found and name not in seen:
            inside = next((c for n, c in others.items() if n.lower() == name), None)
            if inside is not None:
                yield from dsl_lines(inside, others, seen | {name})
        elif not found:
            yield line


def read_dsl(data: bytes, others: dict[str, bytes] | None = None, name: str = "") -> Iterator[Record]:
    """Cards: titles at the line start, bodies indented; # lines are directives, of which #INCLUDE takes in one of the
    other files (by name, and none that is being read); @ starts a sub-card with a link from its card."""
    titles: list[str] = []
    lines: list[str] = []

    def cards() -> Iterator[Record]:
        keys = [k for t in titles for k in expand_title(t)]
        if not keys:
            return
        own, sub, name = [], [], ""
        for line in lines:
            if line.startswith("@"):
                if name:
                    yield Record(["@" + name], "<br/>".join(map(dsl_html, sub)))
                name, sub = line[1:].strip(), []
                if name:
                    own.append(f"<<@{name}>>")
            elif name:
                sub.append(line)
            else:
                own.append(line)
        if name:
            yield Record(["@" + name], "<br/>".join(map(dsl_html, sub)))
        yield Record(keys, "<br/>".join(map(dsl_html, own)))

    for line in dsl_lines(data, others or {}, frozenset([name.lower()])):
        if line.startswith("#"):
            continue
        if line[:1] in ("\t", " "):
            if line.strip():
                lines.append(line.strip())
        elif line.strip():
            if lines:
                yield from cards()
                titles, lines = [], []
            titles.append(line.strip())
    yield from cards()


def read_markdown(data: bytes) -> Iterator[Record]:
    """Second-level headings are entries, headings in a row are aliases, a body of ``see: word`` is a redirect."""
    words: list[str] = []
    body: list[str] = []

    def made() -> Iterator[Record]:
        text = "\n".join(body).strip()
        link = re.fullmatch(r"see:\s*(.+)", text, re.I)
        if words:
            yield Record(list(words), "" if link else text, "html" if re.search(r"<[a-zA-Z]", text) else "text", link[1].strip() if link else "")

    for line in decoded(data).splitlines():
        if line.startswith("## "):
            if any(b.strip() for b in body):
                yield from made()
                words, body = [], []
            words.append(line[3:].strip())
        elif words:
            body.append(line)
    yield from made()


def read_slob(data: bytes) -> Iterator[Record]:
    """Aard 2 containers: several keys of one blob are its headwords; what is not text is skipped."""
    if data[:8] != b"!-1SLOB\x1f":
        raise ValueError("not a slob file")
    at = 8 + 16

    def tiny(width: int) -> bytes:
        nonlocal at
        size = int.from_bytes(data[at : at + width], "big")
        own = data[at + width : at + width + size]
        at += width + size
        return own

    encoding = tiny(1).decode()
    compression = tiny(1).decode()
    count = data[at]
    at += 1
    for _ in range(2 * count):
        tiny(1)
    types = []
    count = data[at]
    at += 1
    for _ in range(count):
        types.append(tiny(2).decode())
    at += 4
    store_at, _ = struct.unpack(">QQ", data[at : at + 16])
    refs_at = at + 16
    n = struct.unpack(">I", data[refs_at : refs_at + 4])[0]
    first = refs_at + 4 + 8 * n
    keys: dict[tuple[int, int], list[str]] = {}
    for i in range(n):
        p = first + struct.unpack(">Q", data[refs_at + 4 + 8 * i : refs_at + 12 + 8 * i])[0]
        size = struct.unpack(">H", data[p : p + 2])[0]
        word = data[p + 2 : p + 2 + size].decode(encoding, "replace")
        bin_, item = struct.unpack(">IH", data[p + 2 + size : p + 8 + size])
        keys.setdefault((bin_, item), []).append(word)
    unpack = {"zlib": zlib.decompress, "lzma2": _lzma2, "bz2": bz2.decompress, "": bytes}[compression]
    bins = struct.unpack(">I", data[store_at : store_at + 4])[0]
    start = store_at + 4 + 8 * bins
    cache: dict[int, tuple[bytes, list[int], bytes]] = {}
    for (bin_, item), words in sorted(keys.items()):
        if bin_ not in cache:
            cache.clear()
            p = start + struct.unpack(">Q", data[store_at + 4 + 8 * bin_ : store_at + 12 + 8 * bin_])[0]
            m = struct.unpack(">I", data[p : p + 4])[0]
            kinds = data[p + 4 : p + 4 + m]
            size = struct.unpack(">I", data[p + 4 + m : p + 8 + m])[0]
            own = unpack(data[p + 8 + m : p + 8 + m + size])
            cache[bin_] = (kinds, list(struct.unpack(f">{m}I", own[: 4 * m])), own[4 * m :])
        kinds, offsets, own = cache[bin_]
        kind = types[kinds[item]]
        size = struct.unpack(">I", own[offsets[item] : offsets[item] + 4])[0]
        if kind.startswith("text/"):
            yield Record(words, own[offsets[item] + 4 : offsets[item] + 4 + size].decode(encoding, "replace"), "html" if "html" in kind else "text")


def _lzma2(data: bytes) -> bytes:
    return lzma.decompress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2}])


#: Redirect records start their body with this marker.
LINK = "@@@LINK="


def link_target(body: str) -> str:
    """The word that a body of nothing but a redirect marker names."""
    seen = re.sub(r"<[^>]*>", "", body).strip()
    return html.unescape(seen[len(LINK) :]).strip() if seen.startswith(LINK) else ""
