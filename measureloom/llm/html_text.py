"""Main text of web pages by composite text density.

Every node of the page gets a density: characters per tag, adjusted for how many of both belong to
links, against the link share of the whole body. The densities of its children add up to the density
sum of a node, and the subtree with the largest sum holds the article. The smallest density on the
path from it up to the body is the threshold for further parts: nodes at or above it are searched in
the same way. Navigation, notices, forms and the like are taken out of the tree before, by element, role
and naming; a name only hints, and yields where its element holds most of the page's text and no article
element lies beside it. Where the
subtree of the largest sum lies in an article element, the chosen parts are widened to those elements.
Every step takes time in proportion to the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*+>", re.DOTALL)
ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# Fixed values of HTML: elements without content, with raw text, and that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening tag ends, if one of them is open in the nearest of its containers.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"}),
        "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"})}

#: Elements that are never part of an article.
OUTSIDE = frozenset("head title script style noscript template nav footer aside form button select option textarea input "
                    "iframe object embed svg canvas audio video map dialog menu label noframes".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
                          "status toolbar".split())
#: Words of class and id that name something beside the article.
OUTSIDE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies disqus footer footnav gdpr login masthead menu menus "
    "modal nav navbar navigation navigator newsletter notice notices notification notifications outbrain pager "
    "pagination paywall popup popups promo promos promotion promotions recommended recommendations related "
    "replies respond share shares sharebar sharing sidebar sidebars signup skyscraper social sponsor sponsored "
    "sponsors subscribe subscription subscriptions taboola toolbar topbar widget widgets".split())
#: Names that do not yield: comments may well be longer than the article, and nothing else has these names.
FIRM_NAMES = frozenset("ad ads adsense advert adverts advertisement advertisements advertising comment comments commentlist "
                       "disqus outbrain replies respond skyscraper sponsor sponsored sponsors taboola".split())
#: Share of the page's text that an element with a telling name has to hold to be kept, and the share
#: of its text in links that it must not reach.
MOST, LINKED = 2 / 3, 1 / 3
CONTAINERS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "children", "outside", "hinted", "chars", "tags", "link_chars", "link_tags", "density",
                 "total", "best", "container", "articles", "in_header", "in_link")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.outside = parent is not None and parent.outside
        self.hinted = False
        self.container = self if tag in CONTAINERS else parent.container if parent is not None else None
        self.in_header = parent is not None and parent.in_header
        self.in_link = tag == "a" or (parent is not None and parent.in_link)
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.articles = 0
        self.best = self


def _is_outside(node: Node, attrs: str) -> bool:
    """Whether an element, by itself, is beside the article; a telling name is noted as a hint."""
    tag = node.tag
    if tag in ("html", "body") or tag in CONTAINERS:
        return False
    if tag in OUTSIDE:
        return True
    if tag == "header":
        if node.container is None:
            return True
        node.in_header = True
    if not attrs or "=" not in attrs:
        return False
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role" and value.strip().lower() in OUTSIDE_ROLES:
            return True
        if name in ("class", "id"):
            words = {w.lower() for w in NAME.findall(value)}
            if words & FIRM_NAMES:
                return True
            if words & OUTSIDE_NAMES or ("header" in words and node.container is None and tag not in HEADINGS):
                node.hinted = True
    return False


def parse(page: str) -> tuple[list[Node], list[tuple[Node, Node, str]]]:
    """Nodes in page order, the body root first, and the texts: (node, its block, raw text)."""
    root = Node("body", None)
    nodes, texts, stack = [root], [], [root]
    at, n = 0, len(page)
    blocks = [root]  # the block node of every open element
    opened = Counter()  # how many elements of a tag are open

    def text(raw: str) -> None:
        if raw and not stack[-1].outside:
            texts.append((stack[-1], blocks[-1], raw))

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in ("body", "html"):
                continue
            if opened[tag]:
                _close(stack, blocks, opened, {tag}, set())
            continue
        if tag == "html":
            continue
        if tag in BLOCK:
            _close(stack, blocks, opened, {"p"}, {"button", "table", "object"})
        if tag in ENDS:
            _close(stack, blocks, opened, *ENDS[tag])
        if tag == "body":
            continue
        node = Node(tag, stack[-1])
        node.outside = node.outside or _is_outside(node, m["attrs"] or "")
        if node.in_header and tag in HEADINGS:
            node.in_header = False
        nodes.append(node)
        stack[-1].children.append(node)
        if tag in VOID or (m["attrs"] or "").endswith("/") and tag not in BLOCK:
            if tag == "hr":
                texts.append((node, node, ""))
            elif tag == "br":
                text(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s>/])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
        opened[tag] += 1
        blocks.append(node if tag in BLOCK else blocks[-1])
    return nodes, texts


def _close(stack: list[Node], blocks: list[Node], opened: Counter, ended: set[str], within: set[str]) -> None:
    """End the innermost open element of the tags, unless one of the containers is nearer."""
    if not any(opened[t] for t in ended):
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in ended:
            for node in stack[k:]:
                opened[node.tag] -= 1
            del stack[k:], blocks[k:]
            return
        if stack[k].tag in within:
            return


def _summed(nodes: list[Node], texts: list[tuple[Node, Node, str]]) -> None:
    """Characters and tags of every subtree, and how many of both belong to links."""
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
    for node, _, raw in texts:
        size = len("".join(raw.split()))
        node.chars += size
        node.link_chars += size if node.in_link else 0
    for node in reversed(nodes):
        up = node.parent
        if up is not None and not node.outside:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")


def settle(nodes: list[Node], texts: list[tuple[Node, Node, str]]) -> list[tuple[Node, Node, str]]:
    """Follow the hints of names.

    Their elements are outside, unless they hold most of the page's text, little of it in links, and no
    article element with text lies beside them.
    """
    _summed(nodes, texts)
    whole = nodes[0].chars
    hinted = any(node.hinted and not node.outside for node in nodes)
    if not hinted:
        return texts
    for node in reversed(nodes):
        outermost = node.container is node and (node.parent is None or node.parent.container is None)
        if outermost and node.chars and not node.outside:
            node.articles = 1
        if node.parent is not None:
            node.parent.articles += node.articles
    for node in nodes:
        if node.parent is not None and node.parent.outside:
            node.outside = True
        elif node.hinted:
            beside = nodes[0].articles - node.articles - (node.container is not None and node.container is not node)
            node.outside = node.chars < MOST * whole or node.link_chars > LINKED * node.chars or beside > 0
    texts = [t for t in texts if not t[0].outside]
    _summed(nodes, texts)
    return texts


def measure(nodes: list[Node]) -> None:
    """Densities and density sums of every node, and the node of the largest sum in every subtree."""
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in reversed(nodes):
        if not node.outside and node.chars:
            c, t = node.chars, node.tags or 1
            lc, lt = node.link_chars or 1, node.link_tags or 1
            base = math.log(c / ((c - node.link_chars) or 1) * node.link_chars + share * c + math.e)
            node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.0001))
            if node.parent is not None:
                node.parent.total += node.density
    for node in reversed(nodes):
        # Children come first here; the first of equal sums in page order wins.
        for child in node.children:
            if not child.outside and child.best.total > node.best.total:
                node.best = child.best


def select(body: Node) -> list[Node]:
    """Roots of the chosen subtrees: the best one, and further parts at or above the path's threshold."""
    target = body.best
    threshold, up = target.density, target
    while up is not body and up is not None:
        threshold = min(threshold, up.density)
        up = up.parent
    chosen, todo = [], [body]
    while todo:
        x = todo.pop()
        if not x.chars or (x is not body and x.density < threshold):
            continue
        chosen.append(x.best)
        todo += [c for c in x.children if not c.outside]
    if target.container is None:
        return [x.container or x for x in chosen]
    return [x.container for x in chosen if x.container is not None]


def main_text(page: str | None) -> str:
    """The article: blocks in page order, joined by line breaks, white space inside a block made one blank."""
    if not page:
        return ""
    nodes, texts = parse(page)
    texts = settle(nodes, texts)
    measure(nodes)
    roots = {id(x) for x in select(nodes[0])}
    inside = {}
    for node in nodes:
        inside[id(node)] = not node.outside and (
            id(node) in roots or (node.parent is not None and inside[id(node.parent)]))
    out, last, parts = [], None, []
    for node, block, raw in texts:
        if not inside[id(node)] or node.in_header:
            continue
        if block is not last:
            out.append("".join(parts))
            parts, last = [], block
        parts.append(html.unescape(raw))
    out.append("".join(parts))
    return "\n".join(x for x in (" ".join(b.split()) for b in out) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page row: the id, the url, text and n_chars, its code points.

    Null and empty pages have an empty text. Whole pages are parsed, whatever their length; ids and urls
    may be null or repeat; other columns are ignored.
    """
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            found = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                ["id", "url", "text", "n_chars"])

    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
