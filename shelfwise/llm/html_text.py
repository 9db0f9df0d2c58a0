"""Main text of HTML pages by composite text density (Sun, Song and Liao, 2011).

Every DOM node has characters, tags, link characters and link tags in its subtree. Its density is characters per tag,
adjusted by a logarithm that falls as more of the text lies in links. A node's density sum adds up the densities of its
children; the node with the largest sum holds the main text. The least density on its path to the body is the
threshold: below it, further nodes are searched only through children that reach it. Sums and candidates are blocks;
inline elements count as tags of their blocks. Page furniture is left out by the names of elements and by the words of
their classes; the latter only where little of the page's text is in it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard and usual names of page furniture.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template noembed noframes xmp svg".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot body html li dd dt".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
_FURNITURE = frozenset("nav header footer aside form button select menu dialog object audio video canvas head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_WORDS = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|"
    r"header|masthead|footer|comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|notice|alert|popup|modal|"
    r"overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|widget|pagination|pager|"
    r"toolbar|skip|copyright|legal|disclaimer|search)(?:$|[_-])",
    re.I,
)
_WHOLE = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments commentlist comment-list cookie-banner "
    "cookie-notice cookies disqus disqus_thread footer newsletter respond sidebar site-footer site-header".split()
)
#: An element with a furniture word in its class goes if it holds at most this share of the page's text.
SHARE = 0.4
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'>][^\s>]*|[=\"'])*+)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: its children are nodes and strings in page order."""

    __slots__ = ("name", "children", "parent", "block", "inside", "opened", "doubt", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent = name, parent
        self.children: list[Node | str] = []
        self.block: Node = self if name in _BLOCK or parent is None else parent.block  # the nearest block, itself included
        self.inside: bool = name in ("article", "main") or (parent is not None and parent.inside)
        self.opened: dict[str, int] = {}  # of a block: its open inline elements by name
        self.doubt = 0  # 1: the class has a furniture word, 2: the class is one
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _furniture(name: str, attributes: str, inside: bool) -> int:
    """3: leave the element out; 2 and 1: its class is or has a furniture word; 0: nothing speaks against it."""
    if name in _FURNITURE:
        return 0 if name == "header" and inside else 3
    doubt = 0
    for key, one, two, three in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, key = one or two or three, key.lower()
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            return 3
        if key == "role" and value.lower() in _ROLES:
            return 3
        if key in ("class", "id") and name not in ("article", "main", "body", "html"):
            for word in value.lower().split():
                if inside and "header" in word:
                    continue  # the headline of an article
                doubt = max(doubt, 2 if word in _WHOLE else int(bool(_WORDS.search(word))))
    return doubt


class _Builder:
    """The open elements while a page is read. Every element is opened and closed once, so the work grows with the page."""

    def __init__(self) -> None:
        self.root = self.top = Node("html", None)
        self.blocks: dict[str, int] = {}  # open blocks by name

    def _count(self, node: Node) -> dict[str, int]:
        return self.blocks if node.block is node else node.block.opened

    def open(self, node: Node) -> None:
        counts = self._count(node)
        counts[node.name] = counts.get(node.name, 0) + 1
        self.top = node

    def close_to(self, node: Node) -> None:
        """Close ``node`` and all inside it."""
        while True:
            done = self.top
            self._count(done)[done.name] -= 1
            self.top = done.parent
            if done is node:
                return

    def close(self, name: str) -> None:
        """An end tag: one that nothing is open for, or an inline one beyond its block, closes nothing."""
        counts = self.blocks if name in _BLOCK else self.top.block.opened
        if counts.get(name, 0):
            node = self.top
            while node.name != name:
                node = node.parent
            self.close_to(node)

    def make_room(self, name: str) -> None:
        """Close what the start of ``name`` ends."""
        if name in _CLOSES_P and self.top.block.name == "p":
            self.close_to(self.top.block)
        same = _SAME.get(name, ())
        counts = lambda n: self.blocks.get(n, 0) + self.top.block.opened.get(n, 0)
        if any(counts(n) for n in same):
            node = self.top
            while node is not self.root and node.name not in _SCOPE[name]:
                if node.name in same:
                    self.close_to(node)
                    return
                node = node.parent


def parsed(page: str) -> Node:
    """The tree of a page without scripts, styles, comments and page furniture. Missing end tags are supplied."""
    tree = _Builder()
    at, skipping, depth = 0, "", 0
    while at < len(page):
        match = _TOKEN.search(page, at)
        if not skipping and (text := page[at : match.start() if match else len(page)]):
            tree.top.children.append(text)
        if not match:
            break
        at = match.end()
        if not match[2]:
            if not skipping and match[0].startswith("<![CDATA["):
                tree.top.children.append(match[0][9:].removesuffix("]]>"))
            continue
        name, closing = match[2].lower(), bool(match[1])
        if skipping:
            if name == skipping and not match[3].endswith("/"):
                depth += -1 if closing else 1
                if depth == 0:
                    skipping = ""
            elif name == "article" and skipping not in ("article", "form") or closing and name in ("body", "html"):
                skipping, depth = "", 0  # an end tag is missing
            else:
                continue
            if skipping == "" and (closing or name != "article"):
                continue
        if not closing and name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|$)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if closing:
            tree.close(name)
            continue
        tree.make_room(name)
        top = tree.top
        if name in _VOID:
            top.children.append(Node(name, top))
            continue
        doubt = _furniture(name, match[3], top.inside)
        if doubt == 3:
            if not match[3].endswith("/"):
                skipping, depth = name, 1
            continue
        if name == "html":
            continue
        node = Node(name, tree.root if name == "body" else top)
        node.doubt = doubt
        if name == "body":
            while tree.top is not tree.root:
                tree.close_to(tree.top)
        node.parent.children.append(node)
        if not match[3].endswith("/") or name in _BLOCK:
            tree.open(node)
    _leave_out(tree.root)
    return tree.root


def _leave_out(root: Node) -> None:
    """Take out the elements whose classes make them furniture: with a whole furniture name unless headline or article are
    in them, with a furniture word if they hold no more than ``SHARE`` of the text."""
    nodes = _nodes(root)
    if not any(node.doubt for node in nodes):
        return
    chars: dict[int, int] = {}
    main: dict[int, bool] = {}
    for node in reversed(nodes):
        chars[id(node)] = sum(len("".join(c.split())) if isinstance(c, str) else chars[id(c)] for c in node.children)
        main[id(node)] = node.name in ("article", "main", "h1") or any(main[id(c)] for c in node.children if isinstance(c, Node))
    limit = SHARE * chars[id(root)]
    for node in nodes:
        small = chars[id(node)] <= limit
        if node.doubt and not main[id(node)] and (small or node.doubt == 2):
            node.children = []
            node.name = "hr"  # a block without text in its place


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _measure(nodes: list[Node]) -> None:
    """Counts and densities of all nodes."""
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            else:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1.0) + 1e-9) / math.log(max(base, 1.0) + 1.0)
        node.total = sum(child.density for child in node.children if isinstance(child, Node) and child.name in _BLOCK)


def _content(root: Node, nodes: list[Node]) -> set[int]:
    """Ids of the nodes whose whole subtrees are main text."""
    best = max(nodes, key=lambda node: node.total)
    if best.total == 0:
        best = max(nodes, key=lambda node: node.density)
    threshold, node = best.density, best
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    marked, todo = set(), [root]
    largest: dict[int, Node] = {}
    for node in reversed(nodes):
        inner = [largest[id(c)] for c in node.children if isinstance(c, Node)]
        largest[id(node)] = max([node, *inner], key=lambda x: x.total)
    while todo:
        node = todo.pop()
        if node.chars and node.density >= threshold:
            found = largest[id(node)]
            marked.add(id(found if found.total > 0 else node))
            todo += [c for c in node.children if isinstance(c, Node) and c.name in _BLOCK]
    return marked


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, two line feeds between them."""
    if not page:
        return ""
    root = parsed(page)
    nodes = _nodes(root)
    _measure(nodes)
    if not root.chars:
        return ""
    marked = _content(root, nodes)
    blocks: list[str] = []
    line: list[str] = []

    def cut() -> None:
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    todo: list[tuple[Node | str, bool, bool]] = [(root, False, True)]
    while todo:
        item, inside, opening = todo.pop()
        if isinstance(item, str):
            if inside:
                line.append(item)
            continue
        if item.name in _BLOCK:
            cut()
        elif item.name == "br":
            line.append(" ")
        if opening:
            inside = inside or id(item) in marked
            todo.append((item, inside, False))
            todo += [(c, inside, True) for c in reversed(item.children)]
    cut()
    return "\n\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    A null, empty or textless page has the empty text. A row depends on its html alone; repeated rows, null ids and other
    columns need no care. Time and memory grow linearly with a page.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
