"""Main text of web pages by composite text density.

Every DOM node gets a density: its characters per tag, adjusted for the share of link characters and link tags.  A
node's density sum is the sum over its children.  The node with the largest density sum is the core of the article;
the least density on its path up to the body is the threshold.  Of every node that reaches it, found from the body
down, the descendant with the largest density sum is kept whole; of other nodes nothing is kept but the page's title (h1)
before the core.  Inside what is kept nothing is dropped but what is no article text by its kind.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, chunks

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
NEVER = frozenset("script style noscript template iframe object svg math canvas audio video button select textarea option input nav aside footer head title menu dialog fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related "
    "search share sharing sidebar sidenav signup skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
# Words beside a mark that turn it into a statement about the layout, or into the article's own header.
LAYOUT_WORDS, OWN_HEADER = frozenset("has with without no".split()), frozenset("article content entry post story".split())
#: Shares of the page's text beyond which a form, or what is marked as comments, is a wrapper of the whole page.
MOST_OF_TEXT = {"wrapper": 0.5, "comments": 0.9}
SCOPES = frozenset("article aside blockquote body button caption details div fieldset figure footer form header html li main nav object section table td th ul ol dl".split())
SELF_CLOSING_RUNS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LIST_SCOPES = frozenset("ul ol dl table select menu".split())
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "dropped", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", noise: str):
        self.tag, self.parent, self.children, self.noise, self.dropped = tag, parent, [], noise, False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def noise_of(tag: str, attrs: list, inside_article: bool) -> str:
    """sure, likely, wrapper, comments or empty: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
    styles and reader comments, by element, role, class and id.  What is likely noise is none if it holds the article;
    a form or what is said to have or not to have comments (wrapper) and comments, also if they hold most of the text."""
    if tag in NEVER or tag == "header" and not inside_article:
        return "sure"
    found = "wrapper" if tag == "form" else ""
    for key, value in attrs:
        value = (value or "").lower()
        if key == "hidden" or key == "role" and value in ROLES or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return "sure"
        if key not in ("class", "id") or tag in ("html", "body", "main"):
            continue
        for name in value.split():
            words = set(SPLIT.split(name))
            if not COMMENTS.isdisjoint(words):
                found = "comments" if found == "comments" or LAYOUT_WORDS.isdisjoint(words) and "closed" not in words else "wrapper"
                continue
            marks = words & MARKS
            if tag != "article" and marks and LAYOUT_WORDS.isdisjoint(words) and not (marks == {"header"} and (inside_article or not OWN_HEADER.isdisjoint(words))):
                found = found or "likely"
    return found


class Tree(HTMLParser):
    """Builds the DOM with the usual implied end tags; text is kept in page order beside the elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", None, "")
        self.stack, self.nodes = [self.root], [self.root]
        self.open: Counter = Counter()  # elements on the stack by tag

    def cut(self, i: int) -> None:
        self.open.subtract(n.tag for n in self.stack[i:])
        del self.stack[i:]

    def pop_to(self, tags: tuple, bounds: frozenset) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self.cut(i)
                return
            if self.stack[i].tag in bounds:
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self.pop_to(("p",), SCOPES)
        if tag in SELF_CLOSING_RUNS:
            self.pop_to(SELF_CLOSING_RUNS[tag], LIST_SCOPES)
        top = self.stack[-1]
        inside = self.open["article"] + self.open["main"] > 0
        node = Node(tag, top, noise_of(tag, attrs, inside))
        top.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack[-1].tag == tag:
            self.cut(-1)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self.cut(i)
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def measure(nodes: list[Node]) -> Node:
    """What is dropped, counts bottom up, then densities and their sums; the body (or the root where there is none)."""
    articles = [n for n in nodes if n.tag in ("article", "main") and not n.noise]
    holds: Counter = Counter()  # articles below each node
    if articles:
        own = set(map(id, articles))
        for n in reversed(nodes):
            if n.parent is not None and (below := holds[id(n)] + (id(n) in own)):
                holds[id(n.parent)] += below
    whole: dict[int, int] = {}
    if any(n.noise in MOST_OF_TEXT for n in nodes):  # characters outside other noise
        whole = {id(n): sum(len("".join(x.split())) for x in n.children if isinstance(x, str)) for n in nodes}
        for node in reversed(nodes):
            if node.parent is not None and not (node.noise == "sure" or node.noise == "likely" and id(node) not in holds):
                whole[id(node.parent)] += whole[id(node)]

    def is_noise(node: Node) -> bool:
        if node.noise not in MOST_OF_TEXT:
            return node.noise == "sure" or node.noise == "likely" and id(node) not in holds
        if articles:  # comments may be articles of their own
            return holds[id(node)] < (len(articles) if node.noise == "comments" else 1)
        return whole[id(node)] <= MOST_OF_TEXT[node.noise] * whole[id(nodes[0])]

    for node in nodes:  # parents come before their children
        node.dropped = node.parent is not None and node.parent.dropped or is_noise(node)
    for node in nodes:
        node.chars = sum(len("".join(x.split())) for x in node.children if isinstance(x, str)) if not node.dropped else 0
    for node in reversed(nodes):  # children come after their parents
        if node.tag == "a":
            node.link_chars = node.chars
        up = node.parent
        if up is not None and not node.dropped:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1)
        if not c or node.dropped:
            continue
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        inner = max(c / max(lc, 1) * t / lt, 1.0 + 1e-9)
        node.density = c / t * math.log(inner) / max(math.log(base) if base > 1 else 1.0, 1.0)
    for node in nodes:  # inline markup divides no text into parts
        node.total = sum(x.density for x in node.children if not isinstance(x, str) and x.tag not in INLINE)
    return body


def chosen(nodes: list[Node], body: Node) -> tuple[list[Node], set[int]]:
    """The root of what is kept, and the ids of nodes below it that are left out."""
    own = [n for n in nodes if not n.dropped and n.chars]
    if not own:
        return [], set()
    core = max(own, key=lambda n: (n.total, n.chars))
    path = [core]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    best: dict[int, Node] = {}
    titles: set[int] = set()  # what has no text but an h1's
    for n in reversed(nodes):  # children come after their parents
        if n.dropped or not n.chars:
            continue
        inner = [x for x in n.children if not isinstance(x, str) and id(x) in best]
        best[id(n)] = max([n, *(best[id(x)] for x in inner)], key=lambda m: (m.total, m.chars))
        if n.tag == "h1" or sum(x.chars for x in inner if id(x) in titles) == n.chars:
            titles.add(id(n))
    kept: set[int] = set()
    reached = [path[-1]]
    while reached:
        n = reached.pop()
        kept.add(id(best[id(n)]))
        reached += [x for x in n.children if not isinstance(x, str) and id(x) in best and id(best[id(n)]) != id(n) and x.density >= threshold]
    on_way: set[int] = set()
    for n in nodes:
        if id(n) in kept:
            while n.parent is not None and id(n.parent) not in on_way:
                n = n.parent
                on_way.add(id(n))
    out: set[int] = set()
    todo, before = [path[-1]], True
    while todo:  # in page order
        n = todo.pop()
        before = before and n is not core
        if id(n) in kept:
            continue
        if id(n) in on_way:
            todo += [x for x in reversed(n.children) if not isinstance(x, str)]
        elif n.tag not in INLINE and n.tag not in VOID and not (before and id(n) in titles):
            out.add(id(n))
    return [path[-1]], out


def main_text(html: str | None) -> str:
    """Blocks of the article in page order, white space inside a block as one space, joined by one space."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    body = measure(tree.nodes)
    roots, left_out = chosen(tree.nodes, body)
    blocks: list[str] = []
    for root in roots:
        run: list[str] = []
        todo: list = [root]
        while todo:
            x = todo.pop()
            if x is None:
                blocks.append("".join(run))
                run.clear()
            elif isinstance(x, str):
                run.append(x)
            elif x.dropped or id(x) in left_out:
                if x.tag not in INLINE:
                    todo.append(None)
            else:
                block = x.tag not in INLINE
                if block:
                    todo.append(None)
                todo.extend(reversed(x.children))
                if block:
                    todo.append(None)
        blocks.append("".join(run))
    return " ".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty html, or one without an article, gives an empty text.  Null ids and urls and repeated rows are kept;
    an empty table gives an empty result; other columns are ignored; pages may be of any length and depth.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in chunks(batch.column("html").to_pylist()):
                texts = [main_text(h) for h in some]
                yield pa.record_batch([batch.column("page_id").slice(first, len(some)), batch.column("url").slice(first, len(some)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    arrow_limits(pages.sparkSession)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
