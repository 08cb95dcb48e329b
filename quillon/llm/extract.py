"""HTML extraction (operator 4) by composite text density.

A page becomes a tree of nodes. For each node the characters, the characters inside links, the tags and the link tags below
it are counted; its composite density is

    C/T * log base ln(C/(C-L) * L + l/C*C0 + e) of (C/L * T/t),   C, T, L, t: characters, tags, link characters, link tags

(with 1 in the place of a zero), where l and C0 stand for the link characters and characters of the body. So text with few
tags is dense, and links make it thin. The density sum of a node is the sum of its children's densities. The node with the
largest density sum holds the article; the smallest density on the path from it up to the body is the threshold that its
blocks have to reach, unless a block's text is mostly free of links. The threshold holds for the whole body: each block element that
reaches it adds the largest density sum below it, and where the added parts have an element of their own around them, that is the
article; so is an element around it that holds little more, like a heading. No tag decides this choice.

Parts that never hold an article go first: by tag or role menus, footers, asides, forms, scripts, styles, dialogs, and headers of the page (that of an article stays);
by class or id containers that are named as such, notices, adverts or reader comments, unless one holds half of the page's text in blocks of its own.

Defined results: a null or empty page has an empty text; broken markup is repaired as browsers do in the common cases (an
open p ends at the next block, unknown end tags are ignored, open elements end with the page); every text inside a block is
kept whole; repeated rows come back as often as they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import bounded, table, with_types

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|[^<]+|<", re.S)
ATTR = re.compile(r"([A-Za-z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACE = re.compile(r"\s+")

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg select object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body caption dd dt html li tbody td tfoot th thead tr".split()) | frozenset(["hr"])
DROP = frozenset("nav header footer aside form button dialog menu noscript script style template iframe select textarea svg object head title input canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span abbr cite mark q sub sup ins del kbd samp var time".split())

# Words in class or id that mark a part of a page that is no article.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing social related recommended recommendations newsletter subscribe subscription signup login toolbar widget pagination pager skip hidden".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
# Elements whose class or id tells what they contain; that of a paragraph or of a phrase does not make it another part of the page.
CONTAINERS = frozenset("div section ul ol dl table figure center details span ins a p".split())
OWN = frozenset("article main section".split())


class Node:
    __slots__ = ("tag", "kids", "parent", "drop", "doubt", "chars", "tags", "links", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, drop: bool, doubt: bool = False) -> None:
        self.tag, self.parent, self.drop, self.doubt, self.kids = tag, parent, drop, doubt, []
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is no article by its tag, role or style, and whether its class or id says so."""
    if tag in DROP:
        return True, False
    if not attrs or tag in ("html", "body"):
        return False, False
    doubt = False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value)
            doubt = doubt or tag in CONTAINERS and bool(MARKS & set(SPLIT.split(spaced.lower())))
        elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", attrs)), doubt


def parse(html: str) -> Node:
    """The tree of a page. Its leaves are strings; comments, declarations and raw elements leave nothing."""
    root = now = Node("#root", None, False)
    raw = None
    at, n = 0, len(html)
    opened: Counter[str] = Counter()  # so that an end tag of nothing open costs no walk

    def leave(to: Node) -> Node:
        up = now
        while up is not to:
            opened[up.tag] -= 1
            up = up.parent
        return to

    while at < n:
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
            at, raw = (end.end() if end else n), None
            continue
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            piece = m[0]
            if piece.startswith("<![CDATA["):
                now.kids.append(piece[9:].removesuffix("]]>"))
            elif not (piece.startswith("<") and len(piece) > 1):
                now.kids.append(unescape(piece))
            continue
        tag, attrs = tag.lower(), m[3] or ""
        if m[1] or m[4]:
            if tag == "br":
                now.kids.append(Node("br", now, False))
                continue
            if opened[tag] > 0:
                up = now
                while up.tag != tag and not (tag in FORMATTING and up.tag in BLOCK):
                    up = up.parent
                if up.tag == tag:
                    now = leave(up.parent)
            continue
        if tag in ENDS_P or tag in SIBLING_ENDS:
            ends, scope = ({"p"}, BLOCK - {"p"}) if tag in ENDS_P else (SIBLING_ENDS[tag], SCOPE[tag])
            if any(opened[x] > 0 for x in ends):
                up = now
                while up is not root and up.tag not in ends and up.tag not in scope:
                    up = up.parent
                while up.tag in ends:
                    now = up = leave(up.parent)
        node = Node(tag, now, *_unwanted(tag, attrs))
        now.kids.append(node)
        if tag in RAW:
            node.drop, raw = True, tag
        elif tag not in VOID and not attrs.rstrip().endswith("/") or tag in BLOCK - {"hr"}:
            now = node
            opened[tag] += 1
    return root


def _order(root: Node) -> list[Node]:
    """Nodes, parents first, without dropped parts. The header of an article or section stays. A part in doubt goes unless it holds half of all text, in blocks."""
    out, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.drop and not (node.tag == "header" and inside):
            node.drop, node.kids = True, []
            continue
        node.drop = False
        out.append(node)
        todo += [(k, inside or node.tag in OWN) for k in reversed(node.kids) if isinstance(k, Node)]
    if not any(x.doubt for x in out):
        return out
    size: dict[Node, int] = {}
    for x in reversed(out):
        size[x] = sum(len(SPACE.sub("", k)) if isinstance(k, str) else size.get(k, 0) for k in x.kids)
    gone: set[Node] = set()
    for x in out:
        if x.parent in gone or x.doubt and not (2 * size[x] >= size[root] and any(isinstance(k, Node) and k.tag in BLOCK for k in x.kids)):
            x.drop, x.kids = True, []
            gone.add(x)
    return [x for x in out if x not in gone]


def _measure(nodes: list[Node]) -> Node:
    """Counts and densities; returns the body, or the root if there is none."""
    for x in reversed(nodes):
        for k in x.kids:
            if isinstance(k, str):
                x.chars += len(SPACE.sub("", k))
            elif not k.drop:
                x.chars += k.chars
                x.tags += k.tags + 1
                x.links += k.links
                x.link_tags += k.link_tags + (k.tag == "a")
        if x.tag == "a":
            x.links = x.chars
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    ratio = body.links / max(1, body.chars)
    for x in nodes:
        if x.chars:
            c, t, l, a = x.chars, max(1, x.tags), max(1, x.links), max(1, x.link_tags)
            base = math.log(c / max(1, c - x.links) * x.links + ratio * c + math.e)
            x.density = max(0.0, c / t * math.log(max(math.e, c / l * t / a)) / base)
    for x in nodes:
        x.total = sum(k.density for k in x.kids if isinstance(k, Node) and not k.drop and k.tag not in FORMATTING)  # phrases are text
    return body


def _best(nodes: list[Node], body: Node) -> Node:
    best = max((x for x in nodes if x is not nodes[0] or x is body), key=lambda x: x.total, default=body)
    if best.total == 0:
        best = body
    while best.parent is not None and best is not body and best.tag not in BLOCK:
        best = best.parent
    return best


def _blocks(top: Node, threshold: float) -> list[str]:
    """Texts of the blocks below a node in order; a br is white space. A block of mostly linked text below the threshold goes."""
    out: list[str] = []
    text: list[str] = []
    weak = [0, 0]  # characters, linked characters of the open block

    def close(density: float) -> None:
        whole = SPACE.sub(" ", "".join(text)).strip()
        if whole and not (weak[1] > 0.5 * weak[0] and density < threshold):
            out.append(whole)
        text.clear()
        weak[:] = [0, 0]

    todo: list[tuple[object, Node, bool, bool]] = [(top, top, False, False)]
    while todo:
        x, owner, linked, leaving = todo.pop()
        if isinstance(x, str):
            text.append(x)
            size = len(SPACE.sub("", x))
            weak[0] += size
            weak[1] += size * linked
        elif leaving:
            close(owner.density)
        elif x.tag == "br":
            text.append(" ")
        elif not x.drop:
            block = x.tag in BLOCK
            if block:
                close(owner.density)
                todo.append((x, x, linked, True))
            inner = linked or x.tag == "a"
            todo += [(k, x if block else owner, inner, False) for k in reversed(x.kids)]
    close(top.density)
    return out


def _tops(nodes: list[Node], best: Node, threshold: float) -> list[Node]:
    """The subtrees that make up the text, in order: of each block at or above the threshold the node with the largest density sum."""
    top = {}
    for x in reversed(nodes):
        top[x] = max((x, *(top[k] for k in x.kids if k in top)), key=lambda t: t.total)
    out: list[Node] = []
    path, chosen = set(), {best}

    def mark(x: Node, end: Node) -> None:
        while x is not end:
            x = x.parent
            path.add(x)

    mark(best, nodes[0])  # the best node may lie outside a body
    todo = [nodes[0]]
    while todo:
        x = todo.pop()
        if x not in path and x not in chosen and x.tag in BLOCK and x.chars and x.density >= threshold:
            t = top[x]
            while t is not x and t.tag not in BLOCK:
                t = t.parent
            chosen.add(t)
            mark(t, x)
        if x in chosen:
            out.append(x)
        else:
            todo += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.drop]
    return out


def _around(tops: list[Node], body: Node, more: float = 1.1, words: int = 120) -> list[Node]:
    """The element below the body that holds all of these parts, if there is one, or one around it that holds little more."""

    def path(x: Node) -> list[Node]:
        out = []
        while x is not None:
            out.append(x)
            x = x.parent
        return out[::-1]

    common = path(tops[0])
    for t in tops[1:]:
        common = [a for a, b in zip(common, path(t), strict=False) if a is b]
    top = common[-1]
    if top is body or body not in common:
        return tops
    while top.parent is not body and top.parent.chars <= more * top.chars + words:
        top = top.parent
    return [top]


def article(html: str | None) -> str:
    if not html:
        return ""
    nodes = _order(parse(html))
    body = _measure(nodes)
    best = _best(nodes, body)
    threshold, up = best.density, best
    while up is not None:
        threshold = min(threshold, up.density)
        up = None if up is body else up.parent
    return "\n\n".join(b for x in _around(_tops(nodes, best, threshold), body) for b in _blocks(x, threshold))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages with an html column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [article(h) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return bounded(with_types(pages, page_id="long", url="string", html="string")).mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
