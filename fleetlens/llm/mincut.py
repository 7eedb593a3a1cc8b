"""Main text of a web page by a minimum cut.

The page becomes a run of text blocks, each with the chain of elements around it. A classifier with
fixed weights (``WEIGHTS``) gives each block a log-odds of being content, from the elements and the
class and id words around it, its length, its end and its share of link text. The log-odds is the
capacity between block and terminal; neighbours in page order, and neighbours below one parent, are
joined by smoothness edges that weigh more the nearer they are in the tree. The minimum cut, found
by augmenting paths, leaves the content on the source's side.

Class, id and role words count whole. An element that holds most of the unlinked text is the page's wrapper
and gets no outside penalty, nor do body, html, main and article for their words.

Scripts, styles, templates, frames, drawings, formula sources, comments and the head are not text; formulas, fallbacks of
objects and noscript are, and the cut judges them. Character references are decoded,
white space inside a block becomes one space, blocks are joined by one space. Null and empty html
give an empty text. Broken markup is read like a browser would: stray end tags are skipped, open
elements end with their parent, an unfinished tag at the end is dropped. Repeated rows give equal
results; extra columns do not matter; an empty table gives no rows. Nothing is cut off.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|svg|head|title|annotation-xml|annotation)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*\Z",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+")
_TOKENS = re.compile(r"\S+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike"
                   " strong sub sup time tt u var wbr math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom"
                   " mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements that are never main text, and those that hold it.
OUTSIDE = frozenset("nav header footer aside form button select textarea menu dialog fieldset input option".split())
INSIDE = frozenset(("article", "main"))
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments consent cookie"
    " cookies copyright disclaimer disqus footer footers form header headers login masthead menu menus modal nav navbar"
    " navigation newsletter notice notices overlay pager pagination popup promo promotion recommend recommended related"
    " replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar"
    " alert alerts widget widgets gdpr complementary contentinfo".split())
INSIDE_WORDS = frozenset("article articlebody content entry main post story text".split())
#: Log-odds: base, inside and outside elements, class words, per 100 characters, sentence end, share of links, list item.
WEIGHTS = {"base": -0.6, "inside": 4.0, "outside": -9.0, "inside_word": 2.0, "outside_word": -9.0, "length": 0.8,
           "length_most": 2.4, "ends": 0.6, "links": -3.0, "heading": 0.2}
SMOOTH, SIBLING = 0.9, 0.6


class _Node:
    __slots__ = ("depth", "inner", "outside", "own", "parent", "plain", "score", "tag", "within")

    def __init__(self, tag: str, parent: _Node | None, own: float = 0.0, outside: float = 0.0):
        self.tag, self.parent, self.own, self.outside = tag, parent, own, outside
        self.depth = parent.depth + 1 if parent else 0
        self.within = tag in INSIDE or parent is not None and parent.within
        # characters of unlinked text below, and of those inside an article or main element
        self.plain = self.inner = 0
        self.score = 0.0


def _element_score(tag: str, attributes: str) -> tuple[float, float]:
    """Log-odds of an element, and the part that it loses where it turns out to be the page's wrapper."""
    score, outside = WEIGHTS["inside"] if tag in INSIDE else 0.0, WEIGHTS["outside"] if tag in OUTSIDE else 0.0
    if attributes and "=" in attributes:
        for _, a, b, c in _ATTRIBUTE.findall(attributes):
            off = inner = False
            for token in _TOKENS.findall((a or b or c).lower()):
                words = _WORDS.findall(token)
                # a word of several parts is outside when all are; one that is so in part tells nothing
                off = off or bool(words) and OUTSIDE_WORDS.issuperset(words)
                inner = inner or OUTSIDE_WORDS.isdisjoint(words) and not INSIDE_WORDS.isdisjoint(words)
            if tag in ("body", "html"):
                continue
            if off and tag not in INSIDE:
                outside += WEIGHTS["outside_word"]
            elif inner:
                score += WEIGHTS["inside_word"]
    if attributes and "h" in attributes and _HIDDEN.search(attributes):
        score += WEIGHTS["outside"]
    return score, outside


def _give_scores(nodes: list[_Node], blocks: list[tuple[str, _Node, float]]) -> None:
    """Scores of all elements, parents first; what holds most of the unlinked text gets no outside penalty.

    Where the page has article or main elements, it has to hold most of their text as well.
    """
    for text, node, linked in blocks:
        node.plain += len(text) - linked
        node.inner += (len(text) - linked) * node.within
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.plain += node.plain
            node.parent.inner += node.inner
    page = nodes[0]
    for node in nodes[1:]:
        wraps = 2 * node.plain > page.plain and 2 * node.inner >= page.inner
        own, above = node.own + (0.0 if wraps else node.outside), node.parent.score
        node.score = min(above, 0.0) + own if own < 0 or above < 0 else above + own


def blocks_of(page: str) -> list[tuple[str, _Node, float]]:
    """(text, innermost block element, characters of link text) of each text block in page order."""
    root = _Node("", None)
    nodes = [root]
    top, links, texts, linked, out = root, 0, [], 0, []
    at = 0

    def end_block():
        nonlocal texts, linked
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                node = top
                while node.tag in INLINE:
                    node = node.parent
                out.append((text, node, min(linked, len(text))))
        texts, linked = [], 0

    for piece in _PIECE.finditer(page):
        if piece.start() > at:
            text = page[at:piece.start()]
            texts.append(text)
            if links:
                linked += len(text.strip())
        at = piece.end()
        tag = piece.group(3)
        if tag is None:
            if piece.group(1):
                texts.append(" ")
            continue
        tag = tag.lower()
        if piece.group(2):
            node = top
            while node is not None and node.tag != tag:
                if node.tag in ("article", "main", "body", "table", "td", "div", "section") and tag in INLINE:
                    node = None
                    break
                node = node.parent
            if tag not in INLINE:
                end_block()
            if node is not None and node.parent is not None:
                walk = top
                while walk is not node.parent:
                    links -= walk.tag == "a"
                    walk = walk.parent
                top = node.parent
            continue
        if tag not in INLINE:
            end_block()
            if tag in ("p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "footer", "nav",
                       "aside", "header", "main", "form", "blockquote", "pre", "li"):
                node = top
                while node is not None and (node.tag in INLINE or node.tag == "p" or node.tag == tag == "li"):
                    if node.tag in ("p", "li"):
                        walk = top
                        while walk is not node.parent:
                            links -= walk.tag == "a"
                            walk = walk.parent
                        top = node.parent
                    node = node.parent
        if tag in VOID or piece.group(4).endswith("/"):
            continue
        top = _Node(tag, top, *_element_score(tag, piece.group(4)))
        nodes.append(top)
        links += tag == "a"
    if at < len(page):
        texts.append(page[at:])
        if links:
            linked += len(page[at:].strip())
    end_block()
    _give_scores(nodes, out)
    return out


def log_odds(text: str, node: _Node, linked: float) -> float:
    score = WEIGHTS["base"] + node.score + min(WEIGHTS["length_most"], WEIGHTS["length"] * len(text) / 100)
    score += WEIGHTS["links"] * linked / len(text)
    if text[-1] in ".!?…\"'”’)":
        score += WEIGHTS["ends"]
    if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        score += WEIGHTS["heading"]
    return score


def _nearness(a: _Node, b: _Node) -> float:
    """Share of the deeper chain that both blocks have in common."""
    most = max(a.depth, b.depth, 1)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return (a.depth + 1) / (most + 1)


def smoothness(nodes: list[_Node]) -> list[tuple[int, int, float]]:
    """Edges between blocks next to each other, on the page and below one parent."""
    edges, last = [], {}
    for i, node in enumerate(nodes):
        if i:
            edges.append((i - 1, i, SMOOTH * _nearness(nodes[i - 1], node) ** 2))
        before = last.get(id(node.parent))
        if before is not None and before != i - 1:
            edges.append((before, i, SIBLING))
        last[id(node.parent)] = i
    return edges


def source_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocks on the content side of the minimum cut; a block that either side may have is not content."""
    n = len(scores)
    left = [max(s, 0.0) for s in scores]
    right = [max(-s, 0.0) for s in scores]
    to: list[list[int]] = [[] for _ in range(n)]
    ends, room = [], []
    for a, b, w in edges:
        to[a].append(len(ends))
        ends.append(b)
        room.append(w)
        to[b].append(len(ends))
        ends.append(a)
        room.append(w)
    while True:
        # shortest augmenting path from a block with room from the source to one with room to the sink
        came: list[int | None] = [None] * n
        queue = deque(i for i in range(n) if left[i] > 1e-12)
        for i in queue:
            came[i] = -1
        goal = -1
        while queue:
            i = queue.popleft()
            if right[i] > 1e-12:
                goal = i
                break
            for e in to[i]:
                j = ends[e]
                if room[e] > 1e-12 and came[j] is None:
                    came[j] = e
                    queue.append(j)
        if goal < 0:
            return [x is not None for x in came]
        path, i = [], goal
        while came[i] >= 0:
            path.append(came[i])
            i = ends[came[i] ^ 1]
        flow = min([left[i], right[goal], *(room[e] for e in path)])
        left[i] -= flow
        right[goal] -= flow
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def main_text(page: str | None) -> tuple[str, int, int]:
    """Main text, number of blocks, number of content blocks."""
    blocks = blocks_of(page) if page else []
    keep = source_side([log_odds(*b) for b in blocks], smoothness([b[1] for b in blocks]))
    return " ".join(b[0] for b, k in zip(blocks, keep, strict=True) if k), len(blocks), sum(keep)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_blocks, n_content."""

    def run(batches):
        for batch in batches:
            got = [main_text(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()),
                pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                pa.array([g[2] for g in got], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks", "n_content"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return in_arrow(rows, run, "page_id long, url string, text string, n_chars long, n_blocks long, n_content long")
