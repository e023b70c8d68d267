"""Article operators that need a real markup reader: readable text, clean HTML, marks, rewritten references.

They run as Arrow functions on batches; everything that a regular expression can say is in ``functions.text``."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from lexiquarry.functions.shipping import ship
from lexiquarry.functions.fold import fold_char

# Element names by role.
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style template noscript iframe object".split())
ALLOWED = frozenset("a abbr b blockquote br caption cite code col colgroup dd del dfn div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q rp rt ruby s samp small span strong sub sup table tbody td tfoot th thead tr u ul var wbr".split())
KEPT_ATTRIBUTES = frozenset("href src alt title lang dir colspan rowspan start".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MOST_MARKS, MOST_PHRASES = 500, 64
MARK = '<mark class="wu-hl">'


def mapped_column(frame: DataFrame, source: str, target: str, change: Callable[[str], str]) -> DataFrame:
    """The frame with a column made from another by a function of one text; nulls stay null."""
    ship(frame.sparkSession)
    names = [*[c for c in frame.columns if c != target], target]
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    schema = ", ".join(f"`{c}` {'string' if c == target else types[c]}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else change(t) for t in b[source].to_pylist()]
            yield pa.record_batch([*(b[c] for c in names[:-1]), pa.array(out, pa.string())], names)

    return frame.mapInArrow(run, schema)


_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_CLASS = re.compile(r"(?:^|,)\s*\w*\.([\w-]+)\s*(?=,|$)")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([\w-]+)", re.I)


def css_displays(css: str) -> dict[str, str]:
    """block, inline or none of each class that a style sheet gives a display by its name alone; later rules win."""
    out: dict[str, str] = {}
    for selectors, body in _RULE.findall(_COMMENT.sub("", css)):
        found = _DISPLAY.findall(body)
        if found and not selectors.strip().startswith("@"):
            kind = "none" if found[-1] == "none" else "inline" if found[-1].startswith("inline") else "block"
            for name in _CLASS.findall(selectors):
                out[name] = kind
    return out


class _Text(HTMLParser):
    def __init__(self, displays: dict[str, str]) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.parts, self.skip = [], [], 0
        self.displays, self.open = displays, []

    def display(self, tag: str, attrs: list) -> str:
        for k, v in attrs:
            if k == "class":
                for name in (v or "").split():
                    if name in self.displays:
                        return self.displays[name]
        return "block" if tag in BLOCKS else "inline"

    def cut(self) -> None:
        line = " ".join("".join(self.parts).split())
        if line:
            self.lines.append(line)
        self.parts.clear()

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.cut()
            return
        kind = "none" if tag in RAW else self.display(tag, attrs)
        self.open.append((tag, kind))
        if kind == "none":
            self.skip += 1
        elif kind == "block":
            self.cut()

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            if tag in BLOCKS:
                self.cut()
            return
        while self.open:
            last, kind = self.open.pop()
            if kind == "none":
                self.skip -= 1
            elif kind == "block":
                self.cut()
            if last == tag:
                break

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def article_text(document: str, displays: dict[str, str] | None = None) -> str:
    """Readable text: blocks and breaks are lines, raw elements are gone, white space is squeezed. displays: what
    style sheets say of classes (``css_displays``)."""
    p = _Text(displays or {})
    p.feed(document)
    p.close()
    p.cut()
    return "\n".join(p.lines)


class _Clean(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.open = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in RAW or tag in ("head", "title"):
            self.skip += 1
        elif not self.skip and tag in ALLOWED:
            kept = "".join(f' {k}="{html.escape(v or "")}"' for k, v in attrs if k in KEPT_ATTRIBUTES and not (v or "").strip().lower().startswith(("javascript:", "data:", "vbscript:")))
            self.out.append(f"<{tag}{kept}>")
            if tag not in VOID:
                self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in RAW or tag in ("head", "title"):
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data):
        if not self.skip:
            self.out.append(html.escape(data, quote=False))


def clean_html(document: str) -> str:
    """Allowed elements and attributes alone; other elements are unwrapped, raw ones dropped, all are closed."""
    p = _Clean()
    p.feed(document)
    p.close()
    return "".join(p.out) + "".join(f"</{t}>" for t in reversed(p.open))


_SPLIT = re.compile(r"(<[^>]*>|&(?:#\d+|#x[0-9a-fA-F]+|\w+);)")
_WORD = re.compile(r"[^\W_]+", re.UNICODE)


@lru_cache(1 << 16)
def fold_word(w: str) -> str:
    return w.lower() if w.isascii() else "".join(map(fold_char, w))


class Marker:
    """Wraps the words of phrases in marks; the last word of an open phrase may go on."""

    def __init__(self, phrases: list[tuple[tuple[str, ...], bool]]) -> None:
        own = []
        for terms, is_open in phrases:
            terms = tuple(fold_word(t) for t in terms)
            lone = len(terms) == 1 and is_open and len(terms[0]) == 1 and not re.match(r"[぀-ヿ㐀-鿿가-힣]", terms[0])
            if terms and not lone and (terms, is_open) not in own:
                own.append((terms, is_open))
        self.phrases = sorted(own[:MOST_PHRASES], key=lambda p: -len(p[0]))

        self.whole = {t[0] for t, o in self.phrases if len(t) > 1 or not o}
        self.starts = tuple(t[0] for t, o in self.phrases if len(t) == 1 and o)

    def _may_start(self, token: str) -> bool:
        return token in self.whole or token.startswith(self.starts)

    def mark(self, document: str) -> str:
        tokens: list[tuple[int, int, str]] = []
        at, raw = 0, ""
        for part in _SPLIT.split(document):
            if part[:1] == "<" and part[-1:] == ">":
                name = re.match(r"</?\s*(\w+)", part)
                name = name[1].lower() if name else ""
                if name in ("script", "style"):
                    raw = "" if part.startswith("</") else name
            elif not (part[:1] == "&" and part[-1:] == ";") and not raw:
                tokens += [(at + m.start(), at + m.end(), fold_word(m[0])) for m in _WORD.finditer(part)]
            at += len(part)
        out, last, i, done = [], 0, 0, 0
        while i < len(tokens) and done < MOST_MARKS:
            n = self._at(tokens, i) if self._may_start(tokens[i][2]) else 0
            for s, e, _ in tokens[i : i + n]:
                out += [document[last:s], MARK, document[s:e], "</mark>"]
                last = e
                done += 1
            i += max(1, n)
        return "".join(out) + document[last:]

    def _at(self, tokens: list, i: int) -> int:
        for terms, is_open in self.phrases:
            own = [t for _, _, t in tokens[i : i + len(terms)]]
            if len(own) == len(terms) and own[:-1] == list(terms[:-1]) and (own[-1] == terms[-1] or is_open and own[-1].startswith(terms[-1])):
                return len(terms)
        return 0


_REF = re.compile(r"""(\s(?:href|src|poster|data|background)\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SET = re.compile(r"""(\ssrcset\s*=\s*)(?:"([^"]*)"|'([^']*)')""", re.I)
_URL = re.compile(r"""(\burl\()\s*(?:"([^"]*)"|'([^']*)'|([^\s"')]*))\s*(?=\))""", re.I)
_ELSEWHERE = re.compile(r"(?:[a-z][a-z0-9+.-]*:|#|/|\?)", re.I)


def rewrite_references(document: str, dict_id: str) -> str:
    """Relative resources under the dictionary's path, in attributes, source sets and styles; already rewritten ones and
    those that climb out of their folder stay; base elements go."""

    def placed(ref: str) -> str:
        own = re.sub(r"^(?:sound|file):/*", "", ref.strip(), flags=re.I)
        if not own or _ELSEWHERE.match(own) or ".." in own.split("/"):
            return ref
        return f"/res/{dict_id}/{re.sub(r'^(?:[.]/+)+', '', own)}"

    def value(m: re.Match) -> str:
        return next(g for g in m.groups()[1:] if g is not None)

    def one(m: re.Match) -> str:
        new = placed(value(m))
        return m[0] if new == value(m) else f'{m[1]}"{new}"'

    def many(m: re.Match) -> str:
        own = re.split(r"(\s*,\s+)", value(m))
        own[::2] = [re.sub(r"^\S+", lambda x: placed(x[0]), v) for v in own[::2]]
        return f'{m[1]}"{"".join(own)}"'

    def style(m: re.Match) -> str:
        new = placed(value(m))
        return m[0] if new == value(m) else f"{m[1]}{new}"

    document = _SET.sub(many, _REF.sub(one, re.sub(r"(?i)<base\b[^>]*>", "", document)))
    return _URL.sub(style, document)


def composed(name: str) -> str:
    """A name with its letters in one piece each."""
    return name if name.isascii() else unicodedata.normalize("NFC", name)
