"""A small block tree of an HTML page with the statistics that content extraction looks at."""

from __future__ import annotations

import math
import re
from html import unescape

import numpy as np

# Attributes as HTML5 reads them: a quote delimits a value only right after the equals sign; inside an
# unquoted value or a name it is a plain character.
_VALUE = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s\"'>][^\s>]*+)"
_NAMED = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE}?+)?+"
_ATTRS = rf"(?:[\s/]++|{_NAMED})*+"
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    # svg and math may close themselves; the slash after an unquoted value is part of the value
    rf"|<(?:svg|math)(?=[\s/])(?:{_NAMED}|\s++|/(?!>))*+/>"
    rf"|<(?P<raw>script|style|template|iframe|noscript|svg|textarea|title|select|math|object|canvas)(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)\s*+>|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|aria-label|data-k|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption nav header "
    "footer aside form fieldset blockquote pre figure figcaption address details summary center head hr button label dialog".split()
)
#: Groups of tags that are one feature each.
GROUPS = [
    {"article", "main"}, {"section", "div", "center"}, {"p"}, {"h1", "h2"}, {"h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"nav"}, {"header"}, {"footer"}, {"aside"},
    {"form", "fieldset", "button", "label", "dialog"}, {"blockquote", "pre", "figure", "figcaption"}, {"#text"}, {"html", "body"},
]
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g}
#: Attribute words, one feature for each kind.
ATTRIBUTES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar skip links",
    "frame": "header footer masthead topbar bottom banner copyright legal colophon site brand logo",
    "side": "sidebar side aside widget widgets related recommended popular trending more teaser rail tags",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted commercial",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr newsletter subscribe subscription signup disclaimer warning",
    "form": "form login search register contact input share sharing social follow print email",
    "comment": "comment comments commentlist disqus reply replies respond discussion responses reader",
    "content": "article content main post entry body text story page prose hentry markdown single",
}
_WORD = {w: i for i, ws in enumerate(ATTRIBUTES.values()) for w in ws.split()}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


class Node:
    __slots__ = ("tag", "parent", "kids", "text", "link", "words", "mark", "own", "depth")

    def __init__(self, tag: str, parent: Node | None, words: tuple = (), mark: str = ""):
        self.tag, self.parent, self.kids, self.words, self.mark = tag, parent, [], words, mark
        self.text, self.link, self.own = "", 0, 1
        self.depth = parent.depth + 1 if parent else 0
        if parent is not None:
            parent.kids.append(self)


def parse(html: str) -> tuple[Node, list[Node]]:
    """(root, nodes in page order). Text runs between block boundaries are "#text" leaves with
    their references decoded and white space joined; scripts, styles and forms' fields have none."""
    root = Node("html", None)
    nodes, stack = [root], [root]
    run: list[str] = []
    anchored = [0]  # open links, characters of linked text in this run
    linked = 0

    def close_run():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                leaf = Node("#text", stack[-1])
                leaf.text, leaf.link = text, min(linked, len(text))
                nodes.append(leaf)
            run.clear()
        linked = 0

    def pop_to(depth: int):
        close_run()
        del stack[depth:]

    at = 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            piece = unescape(html[at : m.start()])
            run.append(piece)
            if anchored[0]:
                linked += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag == "a":
                anchored[0] = max(0, anchored[0] - 1)
            elif tag in BLOCK:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                else:
                    close_run()
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag == "a":
            anchored[0] = 1
            stack[-1].own += 1
            continue
        if tag not in BLOCK:
            stack[-1].own += 1
            continue
        close_run()
        anchored[0] = 0
        for k in range(len(stack) - 1, 0, -1):
            open_ = stack[k].tag
            if open_ == "p":
                pop_to(k)
                break
            if open_ in _CLOSES.get(tag, ()):
                pop_to(k)
                break
            if open_ in _STOPS.get(tag, ()) or (tag not in _CLOSES and open_ != "p"):
                break
        if tag in ("html", "hr"):
            continue
        words, mark = (), ""
        if m["attrs"] and "=" in m["attrs"]:
            found = []
            for name, *values in _ATTR.findall(m["attrs"]):
                value = next((v for v in values if v), "")
                if name.lower() == "data-k":
                    mark = value
                else:
                    found += [w.lower() for w in _TOKEN.findall(value)]
            words = tuple(found)
        if tag not in VOID:
            node = Node(tag, stack[-1], words, mark)
            nodes.append(node)
            stack.append(node)
    if at < len(html):
        run.append(unescape(html[at:]))
    close_run()
    return root, nodes


#: Numbers of a subtree, then of the place among siblings, then tag and attribute indicators.
_SUBTREE = ["chars", "blocks", "mean_block", "link_share", "tag_density", "stop_density", "caps", "digits", "paragraphs", "depth", "start", "end", "share", "kids", "copyright", "parent_share"]
_SIBLING = ["place", "siblings", "before_chars", "before_links", "after_chars", "after_links"]
NAMES = (
    _SUBTREE + _SIBLING + [f"tag{i}" for i in range(len(GROUPS))] + [f"up{i}" for i in range(len(GROUPS))]
    + [f"own_{k}" for k in ATTRIBUTES] + [f"up_{k}" for k in ATTRIBUTES]
)
_MARKS = np.zeros((256, 4))
_MARKS[list(b".!?;:,"), 0] = 1
_MARKS[65:91, 1] = 1
_MARKS[48:58, 2] = 1
_MARKS[0xA9, 3] = 1  # second byte of the copyright sign


def features(trees: list[list[Node]]) -> np.ndarray:
    """One row per node of all pages: subtree statistics, siblings, tags and attribute words of it
    and above. Sums run up and indicators run down one depth at a time, over all pages at once."""
    nodes = [n for t in trees for n in t]
    size = len(nodes)
    if not size:
        return np.zeros((0, len(NAMES)))
    page = np.repeat(np.arange(len(trees)), [len(t) for t in trees])
    place = {id(n): i for i, n in enumerate(nodes)}
    parent = np.array([place[id(n.parent)] if n.parent is not None else -1 for n in nodes])
    depth = np.array([n.depth for n in nodes])
    leaf = np.array([bool(n.text) for n in nodes])
    # chars, links, tags, blocks, paragraphs, stop marks, capitals, digits, copyright signs
    sums = np.zeros((size, 9))
    sums[:, 0] = [len(n.text) for n in nodes]
    sums[:, 1] = [n.link for n in nodes]
    sums[:, 2] = [n.own for n in nodes]
    sums[:, 3] = leaf
    sums[:, 4] = [n.tag == "p" for n in nodes]
    raw = [n.text.encode() for n in nodes if n.text]
    if raw:
        starts = np.cumsum([0, *map(len, raw[:-1])])
        sums[leaf, 5:] = np.add.reduceat(_MARKS[np.frombuffer(b"".join(raw), dtype=np.uint8)], starts)
    own_chars = sums[:, 0].copy()
    before = np.cumsum(own_chars) - own_chars
    first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    start = before - before[first][page]
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    for at in reversed(levels):
        np.add.at(sums, parent[at], sums[at])
    chars = np.maximum(sums[:, 0], 1)
    total = chars[first][page]
    up = np.maximum(parent, 0)
    kids = np.bincount(parent[parent >= 0], minlength=size)
    out = np.zeros((size, len(NAMES)))
    a = len(_SUBTREE)
    out[:, :a] = np.column_stack([
        np.log1p(sums[:, 0]), np.log1p(sums[:, 3]), np.log1p(sums[:, 0] / np.maximum(sums[:, 3], 1)), sums[:, 1] / chars, sums[:, 2] / chars,
        sums[:, 5] / chars, sums[:, 6] / chars, sums[:, 7] / chars, np.log1p(sums[:, 4]), depth, start / total, (start + sums[:, 0]) / total,
        sums[:, 0] / total, np.log1p(kids), leaf & (sums[:, 8] > 0), np.where(parent >= 0, sums[:, 0] / chars[up], 1),
    ])
    # children of one parent, in page order
    order = np.lexsort((np.arange(size), parent))
    order = order[parent[order] >= 0]
    if len(order):
        above = parent[order]
        head = np.r_[True, above[1:] != above[:-1]]
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
        out[order, a] = rank / kids[above]
        out[order, a + 1] = np.log1p(kids[above])
        left, right = order[:-1][~head[1:]], order[1:][~head[1:]]
        out[right, a + 2], out[right, a + 3] = out[left, 0], out[left, 3]
        out[left, a + 4], out[left, a + 5] = out[right, 0], out[right, 3]
    tags, ups = a + len(_SIBLING), a + len(_SIBLING) + len(GROUPS)
    out[np.arange(size), tags + np.array([_GROUP.get(n.tag, 1) for n in nodes])] = 1
    words, word_ups = ups + len(GROUPS), ups + len(GROUPS) + len(ATTRIBUTES)
    found = [(i, _WORD[w]) for i, n in enumerate(nodes) if n.words for w in n.words if w in _WORD]
    for i, k in found:
        out[i, words + k] += 1
    for at in levels:
        above = out[parent[at]]
        out[at, ups:words] = np.maximum(above[:, ups:words], above[:, tags:ups])
        out[at, word_ups:] = np.minimum(above[:, word_ups:] + above[:, words:word_ups], 3)
    return out


def labels(nodes: list[Node]) -> np.ndarray:
    """1 for nodes of the main text: inside a data-k="m" node and no nearer "b", or around one."""
    inside = {}
    for n in nodes:
        inside[id(n)] = n.mark or (inside[id(n.parent)] if n.parent is not None else "")
    y = {id(n): int(inside[id(n)] == "m") for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None and y[id(n)] and inside[id(n.parent)] == "":
            y[id(n.parent)] = 1
    return np.array([y[id(n)] for n in nodes])


def decode(nodes: list[Node], keep: np.ndarray) -> list[str]:
    """The most probable consistent choice: what lies below a dropped node is dropped, and a kept
    node has a kept descendant. Returns the kept text runs in page order."""
    p = np.clip(keep, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log1p(-p)
    place = {id(n): i for i, n in enumerate(nodes)}
    drop, hold, chosen = no.copy(), yes.copy(), {}
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        if n.kids:
            at = [place[id(k)] for k in n.kids]
            drop[i] += sum(drop[k] for k in at)
            best = [k for k in at if hold[k] > drop[k]] or [max(at, key=lambda k: hold[k] - drop[k])]
            chosen[i] = set(best)
            hold[i] += sum(hold[k] if k in chosen[i] else drop[k] for k in at)
        elif not n.text:
            hold[i] = -math.inf
    out = []
    if len(nodes) and hold[0] > -math.inf and hold[0] > drop[0]:
        live = {0}
        for i, n in enumerate(nodes):
            if i in live:
                if n.text:
                    out.append(n.text)
                live |= chosen.get(i, set())
    return out
