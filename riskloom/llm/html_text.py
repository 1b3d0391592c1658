"""Main text of web pages.

Method: composite text density.  A page becomes a tree of elements.  Every
node has its number of characters C, of characters in links LC, of tags T and
of link tags LT below it; its density is C/T, weighted by a logarithm that
grows with the share of unlinked characters and falls, against the body's own
link ratio, where links are dense.  A node's density sum adds the densities of
its child blocks and of its own running text, inline markup included; the node
with the largest sum, the outermost of equals, is the main text.  The smallest
density on its path up to the body is the threshold: of what stands beside the
path, blocks as dense as that and not mostly of links are taken in, and
headings.  Only between equals the marks of the page count: what an article
element around that node holds stays, another article beside it is taken in.

What is never main text is left out before densities are taken: scripts,
styles, menus, headers and footers of the page, sidebars, notices, adverts and
reader comments, by element, role, or a class or id made of words for these
(one that only contains such a word counts if the element is mostly links; ids
of headings, sections and running text do not count); forms, but for one that
holds an article or most of the text.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined by one space in the order of the page.

Cases: null or empty html, and html without text, give the empty text; text
outside of any element is a block of the body; unclosed and stray tags are
repaired; a tag or comment that never ends is left out up to the end; repeated
rows and null ids are answered row by row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, require, without

# Elements by their part in HTML, and words of class or id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
SELF_CLOSED = frozenset("svg math iframe".split())
HEAD_PARTS = frozenset("head base link meta noscript script style template title".split())
LEFT_OUT = RAW | frozenset("head nav footer aside input menu dialog audio video map fieldset select svg template".split())
OUTSIDE_LEFT_OUT = frozenset("header button label".split())  # noise outside of an article only
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
CLOSES_PARAGRAPH = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 "
                             "h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"),
               "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
SAME_AS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
NOISE_WORDS = frozenset("ad ads alert advert advertisement adverts banner banners breadcrumb breadcrumbs comment comments commentlist cookie "
                        "cookies consent disqus footer gdpr menu modal nav navbar navigation newsletter notice notices notification "
                        "paywall popup promo promoted reactions related replies respond share sharing sidebar skip social sponsor sponsored "
                        "subscribe subscription toolbar widget widgets".split())
HEADER_WORDS = frozenset("header masthead topbar logo".split())  # noise outside of an article only
#: Parts of a class or id that only say where a thing is or what holds it.
FRAME_WORDS = frozenset("area article articles bar block bottom box buttons center col column container content entry entries feed fixed form "
                        "global group holder icons inner item items left level link links list main modal outer page panel post posts primary right "
                        "row secondary section site slot sticky story stories top unit wrap wrapper x".split())
#: Where an id names a place of the page; others get theirs from headings and anchors.
HOLDERS = frozenset("div ul ol table center".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())
CORES = frozenset(("article", "main"))

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
                     r"|</?[a-zA-Z][^>]*+(?:>|\Z)", re.S)
#: One attribute; a quoted string without a name is skipped as a whole.
_ATTRIBUTE = re.compile(r"""(?:"[^"]*+"|'[^']*+')|([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
_WORD = re.compile(r"[a-z]+")
_CORE_TAG = re.compile(r"<(?:article|main)\b", re.I)


class Node:
    __slots__ = ("name", "parent", "children", "noise", "doubt", "chars", "linked", "tags", "links", "headed", "flat", "density", "total", "run")

    def __init__(self, name: str, parent: Node | None, noise: bool = False) -> None:
        self.name, self.parent, self.noise, self.doubt = name, parent, noise, ""
        self.children: list[Node | str] = []
        self.chars = self.linked = self.tags = self.links = self.headed = 0
        self.flat = name in INLINE or name in VOID  # inline markup without blocks in it
        self.density = self.total = self.run = 0.0


class _Open:
    """The open elements, by depth; every question is answered without a walk over them."""

    def __init__(self, body: Node) -> None:
        self.stack, self.depths, self.blocks, self.skipped = [body], {}, [0], 0

    def push(self, name: str, noise: bool) -> Node:
        node = Node(name, self.stack[-1], noise)
        if not noise:
            self.stack[-1].children.append(node)
        self.depths.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)
        self.skipped += noise
        return node

    def pop_to(self, depth: int) -> None:
        """Close the element at ``depth`` and all within."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            self.depths[node.name].pop()
            if node.name not in INLINE:
                self.blocks.pop()
            self.skipped -= node.noise

    def last(self, name: str) -> int:
        return self.depths[name][-1] if self.depths.get(name) else 0

    def within_core(self) -> bool:
        return any(self.depths.get(name) for name in CORES)

    def end(self, name: str) -> None:
        """Close the nearest open element of that name; an end of inline markup does not close blocks."""
        depth = self.last(name)
        if depth and (name not in INLINE or depth > self.blocks[-1]):
            self.pop_to(depth)

    def start(self, name: str) -> None:
        """Close what a start tag of that name ends."""
        if self.last("head") and name not in HEAD_PARTS:
            self.pop_to(self.last("head"))
        foreign = max(self.last("svg"), self.last("math"))
        if foreign > self.last("foreignobject") and name in CLOSES_PARAGRAPH:
            self.pop_to(self.depths["svg" if foreign == self.last("svg") else "math"][0])
        if name in CLOSES_PARAGRAPH:
            if self.stack[self.blocks[-1]].name == "p":
                self.pop_to(self.blocks[-1])
        elif name in SAME_CLOSES:
            stop = max(self.last(s) for s in SAME_CLOSES[name])
            found = [depths[k] for same in SAME_AS.get(name, (name,)) if (depths := self.depths.get(same)) and
                     (k := bisect_right(depths, stop)) < len(depths)]
            if found:
                self.pop_to(min(found))


def _attributes(source: str) -> dict[str, str]:
    """Value of each attribute, in lower case; the first of a name counts, as in browsers."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        if m[1]:
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    return found


def _mark(name: str, attributes: str, within_core: bool, by_words: bool) -> str:
    """Whether an element is "noise", noise if it holds mostly "links", a "form", or nothing of that."""
    if name in LEFT_OUT or name in OUTSIDE_LEFT_OUT and not within_core:
        return "noise"
    mark = "form" if name == "form" else ""
    if not attributes:
        return mark
    found = _attributes(attributes)
    role = found.get("role", "")
    if "hidden" in found or found.get("aria-hidden") == "true" or role in NOISE_ROLES:
        return "noise"
    if role == "form":
        mark = "form"
    if not by_words or name in CORES:
        return mark
    words = NOISE_WORDS if within_core else NOISE_WORDS | HEADER_WORDS
    tokens = found.get("class", "").split()
    if name in HOLDERS and "section" not in tokens:
        tokens += found.get("id", "").split()
    for token in tokens:
        parts = _WORD.findall(token)
        if not words.isdisjoint(parts):
            if all(p in words or p in FRAME_WORDS for p in parts):
                return "noise"
            mark = mark or "links"
    return mark


def tree(page: str, by_words: bool = True) -> Node:
    """The page's elements under one body; noise has no content.  ``by_words``
    also takes the words of class and id as marks of noise: a name made of such
    words, or one that only has such a word if the element is mostly links."""
    body, at, doubtful = Node("body", None), 0, False
    now = _Open(body)
    for m in iter(lambda: _MARKUP.search(page, at), None):
        if m.start() > at and not now.skipped:
            now.stack[-1].children.append(html.unescape(page[at: m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            now.end(name)
            continue
        now.start(name)
        if name in ("html", "body"):
            continue
        mark = "noise" if now.skipped else _mark(name, m[3], now.within_core(), by_words)
        if name in VOID or name in SELF_CLOSED and m[3].endswith("/"):
            if not now.skipped and mark != "noise":
                now.stack[-1].children.append(Node(name, now.stack[-1]))
        elif name in RAW:
            at = _raw_end(page, name, at)
        else:
            node = now.push(name, mark == "noise")
            if mark and mark != "noise":
                node.doubt, doubtful = mark, True
    if at < len(page) and not now.skipped:
        now.stack[-1].children.append(html.unescape(page[at:]))
    if doubtful:
        _settle(body, "links")
        _settle(body, "form")
    return body


def _settle(body: Node, doubt: str) -> None:
    """Takes out elements in doubt that hold no article: those of mostly links,
    forms without most of the text around them (of the article or page)."""
    nodes = [body]
    for node in nodes:
        nodes += [c for c in node.children if isinstance(c, Node)]
    if not any(node.doubt == doubt for node in nodes):
        return
    chars, linked, cores = {}, {}, {}
    for node in reversed(nodes):
        below = [c for c in node.children if isinstance(c, Node)]
        chars[node] = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) + sum(chars[c] for c in below)
        linked[node] = chars[node] if node.name == "a" else sum(linked[c] for c in below)
        cores[node] = node.name in CORES or any(cores[c] for c in below)
    scope, out = {body: body}, set()
    for node in nodes[1:]:
        around = scope[node.parent]
        scope[node] = node if node.name in CORES else around
        if node.doubt == doubt and not cores[node] and (2 * linked[node] >= chars[node] if doubt == "links" else 2 * chars[node] <= chars[around]):
            out.add(node)
    for parent in {node.parent for node in out}:
        parent.children = [c for c in parent.children if c not in out]


def _raw_end(page: str, name: str, at: int) -> int:
    m = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
    return m.end() if m else len(page)


def _density(chars: int, linked: int, tags: int, links: int, share: float) -> float:
    """Characters per tag, less where links are dense; ``share`` is the page's share of linked characters."""
    tags = max(1, tags)
    if not chars or not linked:
        return chars / tags
    base = math.log(chars / max(1, chars - linked) * linked + share * chars + math.e)
    ratio = chars / linked * tags / max(1, links)
    return chars / tags * math.log(ratio) / math.log(base) if ratio > 1 and base > 1 else 0.0


def measure(body: Node) -> list[Node]:
    """All nodes, parents first, with their counts, densities and sums of densities."""
    nodes, at = [body], 0
    while at < len(nodes):
        nodes += [c for c in nodes[at].children if isinstance(c, Node)]
        at += 1
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += len("".join(c.split()))
            else:
                node.chars += c.chars
                node.linked += c.linked
                node.headed += c.headed
                node.tags += c.tags + 1
                node.links += c.links + (c.name == "a")
                node.flat &= c.flat
        if node.name == "a":
            node.linked, node.links = node.chars, max(1, node.links)
        if node.name in HEADINGS:
            node.headed = node.chars
    share = body.linked / max(1, body.chars)
    for node in reversed(nodes):
        node.density = _density(node.chars, node.linked, node.tags, node.links, share)
        parts = [c for c in node.children if isinstance(c, Node)]
        flat = [c for c in parts if c.flat]
        chars = node.chars - sum(c.chars for c in parts if not c.flat)
        linked = chars if node.name == "a" else sum(c.linked for c in flat)
        node.run = _density(chars, linked, len(flat) + sum(c.tags for c in flat), sum(c.links + (c.name == "a") for c in flat), share)
        node.total = node.run + sum(c.density for c in parts if not c.flat)
    return nodes


def main_parts(body: Node) -> set[Node]:
    """What to leave out of the page: all but the node of the largest density
    sum (the outermost of equals) and what stands beside its path to the body
    and is as dense as the least dense node of that path."""
    best = max((n for n in measure(body) if not n.flat), key=lambda n: n.total)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    out: set[Node] = set()
    if best is body:  # no block stands out: lists of links go from both ends of the page
        beside = [c for c in body.children if isinstance(c, Node) and c.chars and not c.flat]
        for side in (beside, beside[::-1]):
            for c in side:
                if 2 * c.linked <= c.chars or c.density >= threshold:
                    break
                out.add(c)
    nearest = next((k for k, n in enumerate(path) if n.name == "article"), 0)
    for below, up in zip(path[nearest:], path[nearest + 1:]):  # between equals the marked article decides: all that it holds stays
        for c in up.children:
            if isinstance(c, str) or c is below:
                continue
            dense = up.run >= threshold if c.flat else c.density >= threshold or c.name == "article" or c.headed == c.chars
            if not dense or 2 * c.linked > c.chars:
                out.add(c)
        if up.run < threshold:
            up.children = [c for c in up.children if isinstance(c, Node)]
    return out


def text_of(node: Node, out: set[Node] = frozenset()) -> str:
    """Blocks of a subtree in order, each with single spaces, joined by one space."""
    found: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            found.append(top)
        elif top in out:
            found.append(" ")
        elif top.name in INLINE:
            stack.extend(reversed(top.children))
        else:
            found.append(" ")
            stack.append(" ")
            stack.extend(reversed(top.children))
    return " ".join("".join(found).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    body = tree(page)
    text = text_of(body, main_parts(body))
    if not text or _CORE_TAG.search(page) and not _has_core(body):
        # a frame around the whole page is called like noise: go by elements and roles alone
        body = tree(page, by_words=False)
        text = text_of(body, main_parts(body))
    return text


def _has_core(body: Node) -> bool:
    stack = [body]
    while stack:
        node = stack.pop()
        if node.name in CORES:
            return True
        stack += [c for c in node.children if isinstance(c, Node)]
    return False


def extract(pages: DataFrame, html_col: str = "html", text_name: str = "text", chars_name: str = "n_chars") -> DataFrame:
    """``pages`` without the html, with the main text and its number of code
    points; columns that had these names are replaced."""
    require(pages, html_col)
    page = fresh(pages, "page")
    kept = without(pages, html_col, text_name, chars_name).columns
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html_col}`").cast("string").alias(page))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*kept, text_name, chars_name])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != page)
    return rows.mapInArrow(extracted, f"{fields}`{text_name}` string, `{chars_name}` long")
