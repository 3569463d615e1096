"""Main text of HTML pages by tag-path ratios.

A page is read into blocks of text, each with the path of open elements from
the root to its leaf. Menus, headers, footers, adverts, forms, comments and
other parts that their element or role names as such are left out; so are those
that class or id name, unless they hold the article, see `_furniture`.
For the rest, text length and punctuation are summed by tag path; the ratios
per node are smoothed along the page, fused with the path's own and compared
with their standard deviation. The element that holds the paths above it is the article,
and every block in it is kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)")
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")

RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("head nav aside footer form button select option dialog menu svg canvas object audio video math".split()) | RAW
ARTICLES = frozenset({"article", "main"})
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-links comment comments "
    "consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay pagination pager popup promo promoted promotion recommended related replies reply "
    "respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toc toolbar "
    "topbar widget widgets alert".split()
)
#: Names that stay furniture even if they hold article elements, as comments often do.
STRICT_NAMES = frozenset("comment comments ad ads sponsored promo related".split())
#: In has-sidebar or no-header the name tells of the page around, not of the element.
_COMPOUND = re.compile(r"(?<![a-zA-Z0-9])(?:has|have|with|without|no|not|hide|show)[-_]+[a-zA-Z0-9]+", re.I)
DROPPED_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A new element of the key closes an open one of the values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
}
#: Searching for an element to close stops at these.
SCOPES = frozenset("table ul ol dl div article section main body html td th blockquote".split())
THRESHOLD = 0.3


class Node:
    __slots__ = ("parent", "name", "path", "dropped", "article", "depth", "named")

    def __init__(self, parent: Node | None, name: str, label: str, dropped: bool, article: bool, named: str = ""):
        self.named = named  # "", "name" or "strict"
        self.parent, self.name, self.dropped, self.article = parent, name, dropped, article
        self.path = (parent.path + "/" if parent else "") + label
        self.depth = parent.depth + 1 if parent else 0


def _open(parent: Node, name: str, attributes: str) -> Node:
    dropped, article, label, named = parent.dropped or name in DROPPED, name in ARTICLES, name, ""
    if name == "header" and not any(n.article for n in _up(parent)):
        dropped = True
    if attributes and not dropped:
        for key, *values, hidden in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), html.unescape(next((v for v in values if v), ""))
            if hidden or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                dropped = True
            elif key == "role":
                dropped |= value.lower() in DROPPED_ROLES
                article |= value.lower() in ("main", "article")
            elif key in ("class", "id") and name not in ("html", "body"):
                words = {w.lower() for w in _WORD.findall(_COMPOUND.sub(" ", value))}
                if words & STRICT_NAMES:
                    named = "strict"
                elif words & DROPPED_NAMES and not article:
                    named = named or "name"
                if key == "class" and value.strip():
                    label = name + "." + value.split()[0]
    if named and name in INLINE:
        dropped = True
    return Node(parent, name, label, dropped, article, named)


def _up(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _furniture(found: list[tuple[Node, str]]) -> set[Node]:
    """Elements named as furniture that are it.

    Outside of articles a name doesn't count if the element holds an article
    (comments and adverts may hold some of their own), or more than half of the
    page's text while no article stands outside of it.
    """
    size: dict[Node, int] = {}
    holds: dict[Node, int] = {}
    total = with_article = 0
    for node, text in found:
        above = list(_up(node))
        inside = next((k for k, x in enumerate(above) if x.article and x.named != "strict"), None)
        total += len(text)
        with_article += inside is not None
        for k, x in enumerate(above):
            if x.named:
                size[x] = size.get(x, 0) + len(text)
                holds[x] = holds.get(x, 0) + (inside is not None and inside < k)

    def kept(x: Node) -> bool:
        if any(n.article for n in _up(x.parent)):
            return False
        if holds[x] and x.named != "strict":
            return True
        return 2 * size[x] > total and holds[x] == with_article

    return {x for x in size if not kept(x)}


def blocks(page: str) -> list[tuple[Node, str]]:
    """The text blocks of a page in order, dropped parts left out, each with its innermost block element."""
    out: list[tuple[Node, str]] = []
    node = Node(None, "#root", "#root", False, False)
    holder, parts, at, n = node, [], 0, len(page)

    def flush():
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((holder, text))

    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            mark = n
        if mark > at and not node.dropped:
            if not parts:
                holder = next(x for x in _up(node) if x.name not in INLINE)
            parts.append(page[at:mark])
        if mark == n:
            break
        token = _TOKEN.match(page, mark)
        if not token:
            if not node.dropped:
                if not parts:
                    holder = next(x for x in _up(node) if x.name not in INLINE)
                parts.append("&lt;")
            at = mark + 1
            continue
        at = token.end()
        name = token[2]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            if not node.dropped:
                parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if token[1]:
            target = next((x for x in _up(node) if x.name == name), None)
            if target is not None and target.parent is not None:
                node = target.parent
            continue
        if name in RAW:
            if not token[3].endswith("/") or name in ("script", "style"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name not in INLINE:  # a block ends an open paragraph, and like items end each other
            closing = CLOSES.get(name, set()) | ({"p"} if name not in VOID or name == "hr" else set())
            for x in _up(node):
                if x.name in closing and x.parent is not None:
                    node = x.parent
                    break
                if x.name in SCOPES and x.name not in closing:
                    break
        if name not in VOID and not token[3].endswith("/"):
            node = _open(node, name, token[3])
    flush()
    gone = _furniture(out)
    return [(n, t) for n, t in out if not any(x in gone for x in _up(n))] if gone else out


def _content(found: list[tuple[Node, str]]) -> list[bool]:
    """Which blocks stand on paths whose smoothed and fused ratios pass the threshold."""
    paths = [node.path for node, _ in found]
    kinds = {p: i for i, p in enumerate(dict.fromkeys(paths))}
    index = np.array([kinds[p] for p in paths])
    lengths = np.array([len(t) for _, t in found], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t in found], float)
    nodes = np.bincount(index)
    text_ratio = np.bincount(index, lengths) / nodes
    mark_ratio = np.bincount(index, marks) / nodes
    weights = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    weights /= weights.sum()

    def smooth(values):
        padded = np.pad(values[index], 2, mode="edge")
        return np.convolve(padded, weights, "valid")

    fused = smooth(text_ratio) * (1 + smooth(mark_ratio))
    # the neighbourhood carries a path only as far as its own ratios go along
    by_path = np.sqrt(np.bincount(index, fused) / nodes * text_ratio * (1 + mark_ratio))
    return list(by_path[index] >= THRESHOLD * fused.std())


def main_text(page: str) -> str:
    """The article of a page: its blocks in page order, one per line."""
    found = blocks(page)
    if not found:
        return ""
    articles = [next((x for x in _up(node) if x.article), None) for node, _ in found]
    if any(articles):  # what stands outside every article element competes no more
        found = [f for f, a in zip(found, articles) if a]
    chosen = [node for (node, _), ok in zip(found, _content(found)) if ok] or [node for node, _ in found]
    inside = next((x for x in _up(chosen[0]) if all(x in set(_up(c)) for c in chosen)), None) if len(chosen) < 2 else _common(chosen)
    outer = next((x for x in _up(inside) if x.article), None)
    if outer is None:
        outer = inside if inside.name in SCOPES or inside.parent is None else inside.parent
    return "\n".join(text for node, text in found if outer.depth <= node.depth and any(x is outer for x in _up(node)))


def _common(nodes: list[Node]) -> Node:
    top = nodes[0]
    for node in nodes[1:]:
        while node.depth > top.depth:
            node = node.parent
        while top.depth > node.depth:
            top = top.parent
        while top is not node:
            top, node = top.parent, node.parent
    return top


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    `pages` has page_id, url and html; other columns are ignored. A null or
    empty html, and a page without article, give an empty text and 0; repeated
    rows give repeated results; a page that breaks off is read to its end.
    Pages are independent: no shuffle, memory for one page and one Arrow batch.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [main_text(h.as_py() or "") for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    schema=schema,
                )

    columns = ("cast(page_id as long) page_id", "url", "html")
    return pages.selectExpr(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
