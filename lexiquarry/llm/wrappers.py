"""Main text of web pages by wrapper induction.

Pages of one host share a template. Each page becomes a tree of its block elements, where neighbours of equal
label and shape count as one. A first pass counts the distinct trees of each host, with the texts (by hash) that
stand at every node; trees are merged per host by simple tree matching into a template, and rare texts
are forgotten on the way. A second pass aligns every page with its host's template in the same way: texts that
nearly all pages of the host have at a node are template, the slots whose text varies are content. Inside the page's articles (its main elements where
those hold more text, the whole page where it has neither) content is what is left after template nodes and the
elements that never belong to an article: navigation, headers and footers of the page, asides, forms, scripts,
styles, adverts, notices and comments, told by tag, role, class or id. A class or id counts by its head: its last word that says
more than a shape (``related-posts`` is related, ``related-work`` is not), and none with a word like *with* or *by* counts (``with-sidebar``,
``side-by-side``). Where a page has neither article nor main, a form, or what only its name tells against, stays if it holds over half of the page's text outside links.

Counting covers all pages, and is aggregated per task before the shuffle: one row for each distinct tree
of a host and task, however many pages the host has. Equal trees of all tasks are added up, and distinct ones are merged in slices of
about ``SLICE`` by their hash, round after round, each in order of pages and hash: what is merged with what follows from the pages alone. A merged
template of over ``NODES`` nodes forgets those on under ``RARE`` of its pages. Only which texts may be template comes from these
counts, which forget rare texts; how many pages have them is then counted again, exactly, on pages aligned with the template. Templates are broadcast when they are at most
``SMALL_BYTES`` in all, else joined.

Defined cases: null or empty html has the empty text; a page whose host is unknown, or one of fewer than
``LEAST_PAGES`` pages, has no template nodes; where template nodes are all of a page's text, or over half of
that of its articles or main elements, they stay (a host of copies or near copies); cut-off pages end where they end; elements nested deeper than ``DEEP`` keep their text in the element above; rows with equal page_ids are extracted each; a null url counts as the empty host;
other columns are kept by ``extracted`` (its own text and n_chars replace those of the same names).
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiquarry.functions.shipping import ship

from .common import keeping, mapped, stored, table

#: A node is template if this share of a host's pages, and at least so many, have it with one text.
TEMPLATE_SHARE = 0.8
LEAST_PAGES = 5
#: Texts counted at a node before those on under RARE of its pages are forgotten; counts are short by RARE at most.
COUNTED, RARE = 256, 0.05
#: Trees that one task merges, and nodes of a merged one.
SLICE, NODES = 64, 20_000
SMALL_BYTES = 8 << 20
#: Levels of a tree. Of elements below, only those that decide what is content are levels of their own, MORE at most.
DEEP, MORE = 200, 8
#: Distinct trees that a task holds before it hands them on.
HELD = 4000

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th img".split())
ENDS_P = BLOCK - {"body", "html"}
NEVER = frozenset("nav footer aside form button select option input label dialog menu svg canvas object audio video map head iframe script style noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "commentlist reply replies respond disqus discussion toolbar pagination pager widget widgets skip".split()
)

COMMENT = frozenset("comment comments commentlist disqus discussion reply replies respond".split())
#: Words of a class that say nothing but shape, place or that there are several; and those that make a name one about something else.
SHAPE = frozenset("area article articles bar block bottom box button buttons col column container group heading holder inline inner item items label left link links list module outer panel post posts right row section slot stories story title top unit wrap wrapper".split())
ABOUT = frozenset("by has no not with without".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)""", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    __slots__ = ("tag", "marks", "told", "role", "children", "parent", "slot", "depth", "holds", "bulk")

    def __init__(self, tag: str, marks: tuple, told: frozenset, role: str, parent: Node | None) -> None:
        self.tag, self.marks, self.told, self.role, self.parent = tag, marks, told, role, parent
        #: Whether this holds over half of the text of a page that has neither article nor main.
        self.bulk = False
        self.children: list = []
        self.slot = -1
        self.depth = parent.depth + 1 if parent is not None else 0
        #: Whether an article or main element is inside.
        self.holds = False
        if tag in ("article", "main"):
            while parent is not None and not parent.holds:
                parent.holds = True
                parent = parent.parent


@lru_cache(4096)
def _attributes(text: str) -> tuple[tuple, frozenset, str]:
    """Words of class and id, those of WORDS that they come down to, and the role."""
    marks: list[str] = []
    told = set()
    role = ""
    for name, a, b, c in _MARK.findall(text):
        value = (a or b or c).lower()
        if name.lower() == "role":
            role = value.strip()
        elif name.lower() != "hidden":
            for own in value.split():
                words = [w for w in _SPLIT.split(own) if w]
                marks += words
                head = next((w for w in reversed(words) if w in WORDS or w not in SHAPE), "")
                if head in WORDS and not ABOUT.intersection(words):
                    told.add(head)
    return tuple(marks), frozenset(told), role


def _weighed(root: Node) -> None:
    """Mark the nodes that hold over half of a page's text outside links."""
    order, size = [root], {}
    for node in order:
        order += [c for c in node.children if not isinstance(c, str) and c.tag not in RAW and c.tag != "a"]
    for node in reversed(order):
        size[node] = sum(len(c.strip()) if isinstance(c, str) else size.get(c, 0) for c in node.children)
    for node in order:
        node.bulk = node is not root and 2 * size[node] > size[root]


def parse(text: str) -> Node:
    """The tree of a page; never fails."""
    root = _parsed(text)
    if not root.holds:
        _weighed(root)
    return root


def _parsed(text: str) -> Node:
    """The tree of a page. Text below ``DEEP`` levels stands in the element above, in its place and as
    blocks of its own."""
    root = Node("#root", (), frozenset(), "", None)
    # Elements that are open in a node without being levels.
    hidden: dict[Node, list[str]] = {}
    here, at = root, 0
    lowered: str | None = None
    search = _TOKEN.search
    while True:
        m = search(text, at)
        if m is None:
            if at < len(text):
                here.children.append(text[at:])
            return root
        if m.start() > at:
            here.children.append(text[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag and not (hidden and tag in hidden.get(up, ())):
                up = up.parent
            if hidden and tag in (own := hidden.get(up, [])):
                here = up
                while own.pop() != tag:
                    pass
                _stand_in(tag, here)
            elif up is not root:
                here = up.parent
            continue
        if hidden and hidden.get(here):
            pass
        elif tag in ENDS_P or tag == "p":
            up = here
            while up is not root and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and not (hidden and hidden.get(here)):
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            up = here
            while up is not root and up.tag not in same and up.tag not in ("ul", "ol", "dl", "table", "tbody", "tr" if tag in ("td", "th") else "table"):
                up = up.parent
            if up.tag in same:
                here = up.parent
        attrs = m[3]
        node = Node(tag, *(_attributes(attrs) if attrs.strip() else ((), frozenset(), "")), here)
        if node.depth > DEEP and tag not in RAW and tag not in VOID and not attrs.endswith("/") and not _decides(node):
            hidden.setdefault(here, []).append(tag)
            _stand_in(tag, here)
            continue
        here.children.append(node)
        if tag in RAW:
            if lowered is None:
                lowered = text.lower()
                if len(lowered) != len(text):
                    lowered = text
            close = lowered.find(f"</{tag}", at)
            if close < 0:
                return root
            end = text.find(">", close)
            at = len(text) if end < 0 else end + 1
        elif tag not in VOID and not attrs.endswith("/"):
            here = node


def _stand_in(tag: str, here: Node) -> None:
    """The break in the text that an element makes which is no level."""
    if tag in BLOCK or tag in SPACED:
        here.children.append(Node("hr" if tag in BLOCK else "br", (), frozenset(), "", here))


def _decides(node: Node) -> bool:
    """Whether an element below DEEP levels has to be one: the first article, link or boilerplate on its way down."""
    if node.depth > DEEP + MORE:
        return False
    if node.tag in ("article", "main"):
        return boilerplate(node) or not _in_article(node)
    never = boilerplate(node)
    up = node.parent
    while up is not None and up.tag not in ("article", "main") and up.tag != node.tag and not (never and boilerplate(up)):
        up = up.parent
    return (never or node.tag == "a") and (up is None or up.tag in ("article", "main") or never and not boilerplate(up))


def _in_article(node: Node) -> bool:
    up = node.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None


def boilerplate(node: Node) -> bool:
    """Whether an element is never part of an article. One that holds the article is not, whatever it is called."""
    if node.holds:
        return False
    comment = not COMMENT.isdisjoint(node.told)
    if node.bulk and not comment and (node.tag == "form" or node.tag not in NEVER):
        return False
    if node.tag in NEVER or node.role in ROLES:
        return True
    if node.tag in ("html", "body", "article", "main", "h1"):
        return node.tag == "article" and comment
    hit = set(node.told)
    if node.tag == "header":
        hit.add("header")
    # An article has headers of its own.
    return bool(hit - {"header"}) or bool(hit) and not _in_article(node)


def _plain(parts: list[str]) -> str:
    text = "".join(parts)
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def skeleton(root: Node) -> tuple[tuple, list[set[int]]]:
    """The tree of block elements as (label, children), with neighbours of equal label and shape as one, and the
    hashes of the texts that stand directly in each; nodes get their place (preorder) in ``slot``."""
    hashes: list[set[int]] = []

    def blocks(node: Node, parts: list[str], texts: list[str], out: list[Node]) -> None:
        for c in node.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag in BLOCK:
                texts.append(_plain(parts))
                parts.clear()
                out.append(c)
            elif c.tag not in RAW:
                if c.tag in SPACED:
                    parts.append(" ")
                blocks(c, parts, texts, out)

    def shape(node: Node) -> tuple:
        parts: list[str] = []
        texts: list[str] = []
        inner: list[Node] = []
        blocks(node, parts, texts, inner)
        texts.append(_plain(parts))
        label = node.tag + "".join("." + w for w in node.marks[:3])
        groups: list[list] = []
        for child in inner:
            s = shape(child)
            if groups and groups[-1][0][:2] == s[:2]:
                groups[-1][1].append(s)
            else:
                groups.append([s, [s]])
        return (label, tuple(g[0][:2] for g in groups), node, texts, groups)

    def number(same: list[tuple]) -> None:
        slot = len(hashes)
        hashes.append({_hash(t) for s in same for t in s[3] if t})
        for s in same:
            s[2].slot = slot
        for k in range(len(same[0][4])):
            number([s for x in same for s in x[4][k][1]])

    top = shape(root)
    number([top])
    return top[:2], hashes


def matching(a: tuple | list, b: tuple | list, kids, label, known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching: the size of the best match of two trees, and the pairs of children in it. known
    remembers the matches of parts, for as long as the trees live."""
    if label(a) != label(b):
        return 0, []
    x, y = kids(a), kids(b)
    if not x or not y:
        return 1, []
    known = {} if known is None else known
    key = (id(a), id(b))
    if key in known:
        return known[key]
    score = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    of_label: dict[str, list[int]] = {}
    for j, q in enumerate(y):
        of_label.setdefault(label(q), []).append(j)
    inner = [{j: matching(p, y[j], kids, label, known)[0] for j in of_label.get(label(p), ())} for p in x]
    for i in range(1, len(x) + 1):
        above, row, same = score[i - 1], score[i], inner[i - 1]
        for j in range(1, len(y) + 1):
            best = above[j] if above[j] > row[j - 1] else row[j - 1]
            if j - 1 in same and above[j - 1] + same[j - 1] > best:
                best = above[j - 1] + same[j - 1]
            row[j] = best
    pairs = []
    i, j = len(x), len(y)
    while i and j:
        if j - 1 in inner[i - 1] and score[i][j] == score[i - 1][j - 1] + inner[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    known[key] = score[len(x)][len(y)] + 1, pairs[::-1]
    return known[key]


_LABEL = lambda t: t[0]
_KIDS = lambda t: t[-1]


def pruned(counts: dict, pages: int) -> dict:
    return counts if len(counts) <= COUNTED else {h: n for h, n in counts.items() if n >= RARE * pages}


def as_template(tree: tuple, pages: int, counts: list[dict]) -> list:
    """[label, pages, {hash of a text: pages}, children] of a page tree."""
    at = iter(counts)

    def node(t: tuple) -> list:
        own = next(at)
        return [t[0], pages, own, [node(c) for c in t[1]]]

    return node(tree)


def merge(a: list, b: list, known: dict | None = None) -> list:
    """One template of two of the same root label: matched nodes add up, others stand side by side."""
    known = {} if known is None else known
    _, pairs = matching(a, b, _KIDS, _LABEL, known)
    out, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[3]), len(b[3]))]:
        out += a[3][i:p] + b[3][j:q]
        if p < len(a[3]) and q < len(b[3]):
            out.append(merge(a[3][p], b[3][q], known))
        i, j = p + 1, q + 1
    return [a[0], a[1] + b[1], pruned(added(a[2], b[2]), a[1] + b[1]), out]


def added(a: dict, b: dict) -> dict:
    return {h: a.get(h, 0) + b.get(h, 0) for h in sorted({*a, *b})}


def plus(a: list, b: list) -> list:
    """Two templates of the same shape, added up."""
    return [a[0], a[1] + b[1], pruned(added(a[2], b[2]), a[1] + b[1]), [plus(x, y) for x, y in zip(a[3], b[3])]]


def thinned(t: list) -> list:
    """The template without nodes on few of its pages, if it has very many."""

    def count(n: list) -> int:
        return 1 + sum(map(count, n[3]))

    def keep(n: list) -> list:
        return [n[0], n[1], n[2], [keep(c) for c in n[3] if c[1] >= RARE * t[1]]]

    return keep(t) if count(t) > NODES else t


def shape_of(t: list | tuple) -> tuple:
    return (t[0], tuple(shape_of(c) for c in t[-1]))


@lru_cache(512)
def _loaded(template: str) -> tuple[list, list[dict]]:
    """A template from its JSON, and the texts at each of its nodes in preorder, whose numbers the nodes get."""
    texts: list[dict] = []

    def numbered(t: list) -> list:
        node = [t[0], len(texts), t[3]]
        texts.append({int(h): n for h, n in t[2].items()})
        node[2] = [numbered(c) for c in t[3]]
        return node

    return numbered(json.loads(template)), texts


@lru_cache(2048)
def _aligned(template: str, tree: tuple) -> tuple[int, ...]:
    """For each place of a page tree the number of its node in the template, or -1."""
    out: list[int] = []
    known: dict = {}

    def walk(node: tuple, own: list | None) -> None:
        out.append(-1 if own is None else own[1])
        partner = {q: p for p, q in matching(own, node, _KIDS, _LABEL, known)[1]} if own is not None else {}
        for k, c in enumerate(node[1]):
            walk(c, own[2][partner[k]] if k in partner else None)

    walk(tree, _loaded(template)[0])
    return tuple(out)


@lru_cache(2048)
def _constant(template: str, tree: tuple) -> tuple[frozenset, ...]:
    """For each place of a page tree, the hashes of the texts that are template there."""
    fixed = _loaded(template)[1]
    return tuple(frozenset(fixed[k]) if k >= 0 else frozenset() for k in _aligned(template, tree))


def _texts(node: Node, template: tuple[frozenset, ...] | None, drop) -> list[tuple[str, int, bool]]:
    """(text, characters of links, is template) of each block below a node, in page order."""
    out: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    state = {"slot": node.slot, "links": 0}

    def close() -> None:
        text = _plain(parts)
        if text:
            out.append((text, state["links"], bool(template) and _hash(text) in template[state["slot"]]))
        parts.clear()
        state["links"] = 0

    def walk(n: Node, in_link: bool) -> None:
        for c in n.children:
            if isinstance(c, str):
                parts.append(c)
                if in_link:
                    state["links"] += len(c.strip())
            elif c.tag in RAW or drop(c):
                continue
            elif c.tag in BLOCK:
                close()
                before, state["slot"] = state["slot"], c.slot
                walk(c, in_link)
                close()
                state["slot"] = before
            else:
                if c.tag in SPACED:
                    parts.append(" ")
                walk(c, in_link or c.tag == "a")

    if node.tag not in RAW:
        walk(node, False)
        close()
    return out


def _size(node: Node, template: tuple[frozenset, ...] | None) -> int:
    return sum(len(t) - min(len(t), 2 * links) for t, links, fixed in _texts(node, template, boilerplate) if not fixed)


def _all(node: Node, tags: tuple) -> list[Node]:
    """Outermost elements of these tags outside boilerplate."""
    out = []
    for c in node.children:
        if not isinstance(c, str) and not boilerplate(c):
            out += [c] if c.tag in tags or (c.role == "main" and "main" in tags) else _all(c, tags)
    return out


def _region(root: Node, template: tuple[frozenset, ...] | None) -> list[Node]:
    """All articles of a page, or its main elements where those hold more text than the articles, or else the page."""
    articles, mains = _all(root, ("article",)), _all(root, ("main",))
    if articles and mains:
        return max(articles, mains, key=lambda found: sum(_size(n, template) for n in found))
    return articles or mains or [root]


def main_text(html: str | None, template: str | None = None) -> str:
    """The article of one page, given its host's template (JSON) if it has one."""
    if not html:
        return ""
    root = parse(html)
    fixed = None
    if template:
        fixed = _constant(template, skeleton(root)[0])
    region = _region(root, fixed)
    blocks = [b for n in region for b in _texts(n, fixed, boilerplate)]
    content = [t for t, _, is_template in blocks if not is_template]
    if content and region != [root] and 2 * sum(map(len, content)) < sum(len(t) for t, _, _ in blocks):
        content = []
    return "\n\n".join(content or [t for t, _, _ in blocks])


_TREES = "host string, shape string, n long, tree string"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    host, shape, n, tree = zip(*rows) if rows else ((), (), (), ())
    return pa.record_batch({"host": pa.array(host, pa.string()), "shape": pa.array(shape, pa.string()), "n": pa.array(n, pa.int64()), "tree": pa.array(tree, pa.string())})


def _packed(t: list) -> str:
    return json.dumps(t, separators=(",", ":"))


def _digest(t: list) -> str:
    return xxhash.xxh3_128_hexdigest(json.dumps(shape_of(t), separators=(",", ":")))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct trees of a host and task: how many pages, and the texts at each place with their pages."""
    held: dict[tuple, list] = {}

    def handed() -> pa.RecordBatch:
        rows = []
        for (host, tree), (n, counts) in held.items():
            t = as_template(tree, n, counts)
            rows.append((host, _digest(t), n, _packed(t)))
        held.clear()
        return _rows(rows)

    for batch in batches:
        for host, page in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            if not page:
                continue
            tree, h = skeleton(parse(page))
            own = held.get((host, tree))
            if own is None:
                own = held[host, tree] = [0, [{} for _ in h]]
            own[0] += 1
            for k, texts in enumerate(h):
                counts = own[1][k]
                for t in texts:
                    counts[str(t)] = counts.get(str(t), 0) + 1
                if len(counts) > 4 * COUNTED:
                    own[1][k] = pruned(counts, own[0])
        if len(held) >= HELD:
            yield handed()
    yield handed()


def _summed(rows):
    """Trees of one host and shape as one."""
    first, *more = sorted(rows["tree"].to_pylist())
    total = json.loads(first)
    for t in more:
        total = plus(total, json.loads(t))
    return pa.Table.from_batches([_rows([(rows["host"][0].as_py(), rows["shape"][0].as_py(), total[1], _packed(total))])])


def _merged(rows):
    """Trees of one host as one template, those of the most pages first."""
    trees = sorted(zip((-n for n in rows["n"].to_pylist()), rows["shape"].to_pylist(), rows["tree"].to_pylist()))
    template = json.loads(trees[0][2])
    for _, _, t in trees[1:]:
        template = thinned(merge(template, json.loads(t)))
    return pa.Table.from_batches([_rows([(rows["host"][0].as_py(), _digest(template), template[1], _packed(template))])])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many pages of a task have each candidate text of their template at its node."""
    met: dict[tuple, int] = {}

    def handed() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in met.items()]
        met.clear()
        host, node, text, n = zip(*rows) if rows else ((), (), (), ())
        return pa.record_batch({"host": pa.array(host, pa.string()), "node": pa.array(node, pa.int32()), "h": pa.array(text, pa.string()), "n": pa.array(n, pa.int64())})

    for batch in batches:
        for host, page, template in zip(*(batch[c].to_pylist() for c in ("host", "html", "template"))):
            if not page:
                continue
            tree, hashes = skeleton(parse(page))
            texts = _loaded(template)[1]
            for node, own in zip(_aligned(template, tree), hashes):
                for h in own & texts[node].keys() if node >= 0 else ():
                    met[host, node, str(h)] = met.get((host, node, str(h)), 0) + 1
        if len(met) >= HELD:
            yield handed()
    yield handed()


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates with the texts of their found nodes alone."""
    for batch in batches:
        out = []
        for template, found in zip(batch["template"].to_pylist(), batch["found"].to_pylist()):
            texts: dict[int, dict] = {}
            for f in found or ():
                texts.setdefault(f["node"], {})[f["h"]] = f["n"]
            at = iter(range(1 << 62))

            def node(t: list) -> list:
                k = next(at)
                return [t[0], t[1], texts.get(k, {}), [node(c) for c in t[3]]]

            out.append(_packed(node(json.loads(template))))
        yield pa.record_batch([batch["host"], pa.array(out, pa.string())], ["host", "template"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h, t) for h, t in zip(batch["html"].to_pylist(), batch["template"].to_pylist())]
        yield pa.record_batch([batch["kept"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["kept", "text", "n_chars"])


def _candidates(template: str) -> str:
    """The template with the texts alone that at least half of its pages may have: counts fall short by RARE a step."""

    def node(t: list, pages: int) -> list:
        return [t[0], t[1], {h: n for h, n in t[2].items() if 2 * n >= pages}, [node(c, pages) for c in t[3]]]

    t = json.loads(template)
    return _packed(node(t, t[1]))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch["host"], batch["n"], pa.array([_candidates(t) for t in batch["tree"].to_pylist()], pa.string())], ["host", "n", "template"])


def _folded(trees: DataFrame, keys: list[str], by: str, run) -> DataFrame:
    """The trees of equal keys as one, in rounds: no task takes many more than SLICE of them at a time."""
    while True:
        n = trees.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
        most = n.agg(F.max("_n")).first()[0] or 0
        if most <= 1:
            return trees
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        slices = trees.join(n, same).withColumn("slice", F.pmod(F.xxhash64(by), F.ceil(F.col("_n") / SLICE)))
        trees = stored(slices.select("host", "shape", "n", "tree", "slice").groupBy(*keys, "slice").applyInArrow(run, _TREES))


def templates(pages: DataFrame) -> DataFrame:
    """host and template of every host of at least LEAST_PAGES pages. pages: host and html."""
    trees = stored(mapped(pages.select("host", "html"), _trees, _TREES))
    many = trees.groupBy(F.col("host").alias("h")).agg(F.sum("n").alias("pages")).filter(F.col("pages") >= LEAST_PAGES)
    trees = stored(trees.join(many, F.col("host") == F.col("h")).select("host", "shape", "n", "tree"))
    ship(pages.sparkSession)
    trees = _folded(_folded(trees, ["host", "shape"], "tree", _summed), ["host"], "shape", _merged)
    likely = stored(mapped(trees.select("host", "n", "tree"), _likely, "host string, n long, template string"))
    rows = with_templates(pages.select("host", "html"), likely.select("host", "template")).filter(F.col("template").isNotNull())
    found = mapped(rows.select("host", "html", "template"), _met, "host string, node int, h string, n long").groupBy("host", "node", "h").agg(F.sum("n").alias("n"))
    own = likely.select(F.col("host").alias("k"), F.col("n").alias("pages"))
    found = found.join(own, F.col("host") == F.col("k")).filter(F.col("n") >= F.greatest(F.lit(float(LEAST_PAGES)), TEMPLATE_SHARE * F.col("pages")))
    found = found.groupBy(F.col("host").alias("k")).agg(F.collect_list(F.struct("node", "h", "n")).alias("found"))
    fixed = likely.join(found, F.col("host") == F.col("k"), "left").select("host", "template", "found")
    return mapped(fixed, _fixed, "host string, template string")


def with_templates(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with the templates of their hosts, null where there is none. known: host and template, as a table."""
    known = known.select(F.col("host").alias("_known"), "template")
    size = known.agg(F.coalesce(F.sum(F.octet_length("template") + F.octet_length("_known")), F.lit(0))).first()[0]
    return rows.join(F.broadcast(known) if size <= SMALL_BYTES else known, F.col("host") == F.col("_known"), "left").drop("_known")


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extracted(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but html, text and n_chars by default), and text and n_chars of every page."""
    keep = keep if keep is not None else [c for c in pages.columns if c not in (html, "text", "n_chars")]
    held = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = pages.select(held.alias("own"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    rows = with_templates(rows, stored(templates(rows.select("host", "html"))))
    out = keeping(rows, ["own"], {"html": F.col("html"), "template": F.col("template")}, _extracted, "text string, n_chars long")
    return out.select(*[F.col("own").getField(c).alias(c) for c in keep], "text", "n_chars")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"), keep=["page_id", "url"])
