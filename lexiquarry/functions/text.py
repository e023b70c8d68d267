"""Text scalars over article bodies, as native expressions: stripping, references, links, resource names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The entities that articles are written with, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
RAW_ELEMENTS = r"(?is)<(?:script|style)(?:[^>]*[^/>])?>.*?</(?:script|style)[^>]*>"
TAG = r"(?s)<[^>]*>"
#: Attributes that hold one reference, those that hold a list of them, and references of styles; values may be quoted either way or bare.
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
REFERENCE = r"(?i)\s(?:href|src|poster|data|background)\s*=\s*" + VALUE
SOURCES = r"(?i)\ssrcset\s*=\s*" + VALUE
STYLE_URL = r"""(?i)\burl\(\s*("[^"]*"|'[^']*'|[^\s"')]*)\s*\)"""

#: Asset extensions and their media types.
MIME = {
    "css": "text/css", "js": "text/javascript", "html": "text/html", "txt": "text/plain", "xml": "text/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp", "ico": "image/x-icon", "tif": "image/tiff", "tiff": "image/tiff", "mp3": "audio/mpeg", "ogg": "audio/ogg", "wav": "audio/wav", "spx": "audio/ogg",
    "opus": "audio/ogg", "flac": "audio/flac", "m4a": "audio/mp4", "mp4": "video/mp4", "webm": "video/webm", "ogv": "video/ogg", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2", "pdf": "application/pdf",
}
#: Names that operating systems write on their own.
JUNK_NAMES = [".ds_store", "__macosx", ".spotlight-v100", ".documentrevisions-v100", ".temporaryitems", ".trashes", ".fseventsd", ".apdisk", ".volumeicon.icns", "thumbs.db", "ehthumbs.db", "desktop.ini"]
JUNK = r"(?i)(?:^|[/\\])\s*(?:\._[^/\\]*|" + "|".join(n.replace(".", r"\.") for n in JUNK_NAMES) + r")\s*(?:[/\\]|$)"


def unescape(c: Column) -> Column:
    return reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def strip_html(c: Column) -> Column:
    """Words of an article for indexing: raw elements and tags gone, entities decoded, white space squeezed."""
    text = F.regexp_replace(F.regexp_replace(c, RAW_ELEMENTS, ""), TAG, " ")
    return F.trim(F.regexp_replace(unescape(text), r"\s+", " "))


def display_text(c: Column) -> Column:
    return unescape(unescape(c))


def escape_text(c: Column) -> Column:
    return reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], c)


def escape_attr(c: Column) -> Column:
    return F.replace(escape_text(c), F.lit('"'), F.lit("&#34;"))


def body_of(text: Column, kind: Column) -> Column:
    """HTML as it is; plain text as paragraphs with line breaks; other kinds are an error of the reader (null)."""
    return F.when(kind == "html", text).when(kind == "text", F.concat(F.lit("<p>"), F.replace(escape_text(text), F.lit("\n"), F.lit("<br/>")), F.lit("</p>")))


def _bare(c: Column) -> Column:
    """A value without its quotes."""
    return F.regexp_replace(c, "^[\"']|[\"']$", "")


def references(c: Column) -> Column:
    """References of attributes, then of source sets, then of styles, each in document order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(1)), _bare)
    lists = F.transform(F.regexp_extract_all(c, F.lit(SOURCES), F.lit(1)), lambda v: F.split(F.trim(_bare(v)), r"\s*,\s+"))
    sets = F.transform(F.flatten(lists), lambda v: F.regexp_extract(v, r"^\S*", 0))
    styles = F.transform(F.regexp_extract_all(c, F.lit(STYLE_URL), F.lit(1)), _bare)
    return F.concat(found, F.filter(F.concat(sets, styles), lambda v: v != ""))


def is_relative_asset(ref: Column) -> Column:
    return (ref != "") & ~ref.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|#|\?|//)") & ~ref.contains("..")


LINK = r"""(?i)(\s(?:href|src)\s*=\s*["']?)"""


def canonical_links(c: Column) -> Column:
    """Lookup links in one spelling: entry:// for words, whichever scheme names them, and entry:@ for sub-entries."""
    return F.regexp_replace(F.regexp_replace(c, LINK + "bword:(?://)?", "$1entry://"), LINK + "entry://@", "$1entry:@")


def encode_target(c: Column) -> Column:
    """A headword as it stands behind entry://: percent, number sign, controls and a leading @ are percent-encoded."""
    codes = ["%", "#", *map(chr, range(32)), "\x7f"]
    out = reduce(lambda a, x: F.replace(a, F.lit(x), F.lit(f"%{ord(x):02X}")), codes, c)
    return F.regexp_replace(out, "^@", "%40")


def resource_key(c: Column) -> Column:
    """One spelling of a resource name: forward slashes, no empty, dot or climbing segments, lower case. Names whose
    letters may be spelled in parts go through ``operators.articles.composed`` first."""
    parts = F.filter(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))
    return F.lower(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))


def mime(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in MIME.items() for x in (k, v)])
    return F.coalesce(F.element_at(known, extension(c)), F.lit("application/octet-stream"))


def is_asset(c: Column) -> Column:
    return extension(c).isin(*MIME)


def glob_regex(glob: str) -> str:
    """A resource glob: * and ? inside a segment, ** across, a trailing slash for a folder, a bare name at any depth."""
    out, i = "", 0
    g = glob.lower().replace("\\", "/").lstrip("/")
    if g.endswith("/"):
        g += "**"
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + g[i] if g[i] in r".+()[]{}^$|" else g[i]), i + 1
    return "^" + ("" if "/" in g else "(?:.*/)?") + out + "$"


def is_junk(c: Column) -> Column:
    return c.rlike(JUNK)


def user_title(c: Column) -> Column:
    """A title that a user gave: white space as single spaces, no controls, at most 200 characters; null where nothing is left."""
    spaced = F.regexp_replace(c, r"[\p{Z}\t-\r\x{85}]+", " ")
    clean = F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[\x00-\x1f\x7f-\x{9f}]", ""), " +", " "))
    return F.nullif(F.trim(F.substring(clean, 1, 200)), F.lit(""))


def flag(c: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "0", "false", "no", "off")


def media_markup(name: Column) -> Column:
    kind = F.substring_index(mime(name), "/", 1)
    src = escape_attr(name)
    return (
        F.when(kind == "image", F.concat(F.lit('<img src="'), src, F.lit('">')))
        .when(kind == "audio", F.concat(F.lit('<audio controls src="'), src, F.lit('"></audio>')))
        .when(kind == "video", F.concat(F.lit('<video controls src="'), src, F.lit('"></video>')))
        .otherwise(F.concat(F.lit('<a href="'), src, F.lit('">'), escape_text(name), F.lit("</a>")))
    )
