"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks, cut at block-level tags. Each block
is described by its word count and link density, by those of the blocks before
and after it, and by where it stands: inside or outside the page's main area, and
how far the parts around it are marked as a menu, footer, advert, form, notice or
comment, by tag or role and by class or id. A class or id is a full mark if all of its words
are of that kind (``comment-list``), half a mark if some are (``related-work``). Decision trees, one for each kind of area, trained
here on the labelled table below, say which blocks are main text: link lists
inside the main area go, long text outside it stays, and so does prose of the main area
under half a mark. No mark drops a block by itself; what a mark means is learnt from the table.

Defined results: null and empty pages give the empty text; mark-up that is cut
off ends with the page; character references are decoded, white space inside a
block becomes one space and blocks are joined by one space; nothing is capped.
Repeated rows give equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML, and words of class, id and role that mark parts beside the main text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("address article aside body details dialog div dl fieldset figure footer form header html main menu nav ol section table td th tr ul li p span".split())
SCOPES = frozenset("article aside body dialog footer form header html main nav table td".split())
DROPPED = frozenset("script style noscript template textarea title iframe svg math object select button canvas audio video head".split())
BESIDE_TAGS = frozenset("nav aside footer form dialog menu fieldset".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BESIDE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidenav side rail nav navbar navigation menu submenu topbar toolbar breadcrumb breadcrumbs footer foot copyright header masthead comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search searchbox form share sharing social related recommended recommendations pagination pager widget tags taglist hidden".split()
)
STRUCTURE_WORDS = frozenset(
    "area articles bar block blocks body bottom box button buttons center col column container content fixed global group icon icons inline inner item items left link links list main menu outer page panel post posts primary right row secondary section set site slot small stack sticky story stories text title top unit wrap wrapper".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Words, link density; the same of the block before and after; area (1 inside
#: the main area, 0 the page has none, -1 outside it); mark (1 inside a part that is
#: marked by tag, role or all of a class or id, 0.5 by some of it); whether it is main text.
LABELLED = [
    (120, 0.00, 80, 0.00, 90, 0.00, 1, 0, 1), (1, 0.00, 60, 0.00, 40, 0.00, 1, 0, 1), (8, 0.00, 2, 0.00, 70, 0.00, 1, 0, 1),
    (3, 0.00, 0, 0.00, 5, 0.00, 1, 0, 1), (40, 0.20, 30, 0.00, 30, 0.10, 1, 0, 1), (2, 0.00, 1, 0.00, 1, 0.00, 1, 0, 1),
    (15, 0.50, 60, 0.00, 40, 0.00, 1, 0, 1), (1, 1.00, 50, 0.00, 20, 0.00, 1, 0, 0), (300, 0.02, 0, 0.00, 0, 0.00, 1, 0, 1),
    (25, 0.00, 20, 1.00, 4, 1.00, 1, 0, 1), (10, 0.00, 90, 0.00, 12, 0.00, 1, 0, 1), (5, 0.00, 8, 0.00, 100, 0.00, 1, 0, 1),
    (6, 1.00, 4, 1.00, 5, 1.00, 1, 0, 0), (12, 0.80, 3, 1.00, 40, 0.00, 1, 0, 0), (3, 0.00, 2, 1.00, 4, 1.00, 1, 0, 1),
    (2, 0.60, 5, 0.50, 0, 0.00, 1, 0, 0), (4, 0.00, 3, 0.70, 9, 0.00, 1, 0, 1), (5, 1.00, 0, 0.00, 3, 1.00, 1, 0, 0),
    (20, 0.00, 30, 0.00, 1, 0.00, 1, 0, 1), (1, 0.00, 10, 0.00, 0, 0.00, 1, 0, 1), (50, 0.00, 20, 0.00, 0, 0.00, 1, 0, 1),
    (2, 0.00, 9, 0.00, 2, 0.00, 1, 0, 1), (1, 0.00, 80, 0.00, 1, 0.00, 1, 0, 1), (7, 0.00, 120, 0.00, 2, 0.00, 1, 0, 1),
    (8, 1.00, 40, 0.00, 2, 0.00, 1, 0, 0), (3, 0.70, 60, 0.00, 1, 0.00, 1, 0, 0), (2, 1.00, 2, 1.00, 0, 0.00, 1, 0, 0),
    (1, 1.00, 5, 0.00, 2, 1.00, 1, 0, 0), (11, 0.90, 7, 0.60, 1, 1.00, 1, 0, 0), (4, 1.00, 1, 0.00, 1, 0.00, 1, 0, 0),
    (9, 1.00, 9, 1.00, 9, 1.00, 1, 0, 0), (40, 0.60, 20, 0.70, 30, 0.60, 1, 0, 0),
    (30, 0.00, 60, 0.00, 20, 0.00, 1, 1, 0), (4, 1.00, 4, 1.00, 4, 1.00, 1, 1, 0), (80, 0.00, 100, 0.00, 2, 0.00, 1, 1, 0),
    (2, 0.00, 40, 0.00, 1, 0.00, 1, 1, 0), (12, 0.10, 80, 0.00, 15, 0.00, 1, 1, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, -1, 1, 0), (9, 0.00, 1, 1.00, 8, 0.00, -1, 1, 0), (12, 0.00, 60, 0.00, 0, 0.00, -1, 1, 0),
    (60, 0.00, 90, 0.00, 10, 0.00, -1, 1, 0), (20, 0.40, 5, 0.00, 9, 1.00, -1, 1, 0),
    (10, 0.00, 3, 1.00, 60, 0.00, -1, 0, 0), (30, 0.00, 1, 0.00, 2, 1.00, -1, 0, 0), (4, 0.50, 2, 1.00, 1, 0.00, -1, 0, 0),
    (2, 0.00, 40, 0.00, 0, 0.00, -1, 0, 0), (70, 0.10, 4, 0.50, 30, 0.00, -1, 0, 1),
    (90, 0.00, 70, 0.00, 80, 0.00, 0, 0, 1), (45, 0.10, 8, 0.00, 60, 0.00, 0, 0, 1), (20, 0.00, 60, 0.00, 40, 0.00, 0, 0, 1),
    (12, 0.00, 30, 0.00, 50, 0.00, 0, 0, 1), (3, 0.00, 40, 0.00, 60, 0.00, 0, 0, 1), (7, 0.00, 2, 1.00, 90, 0.00, 0, 0, 1),
    (60, 0.00, 4, 1.00, 3, 1.00, 0, 0, 1), (25, 0.05, 50, 0.00, 4, 1.00, 0, 0, 1), (150, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1),
    (20, 0.00, 18, 0.00, 9, 0.00, 0, 0, 1), (16, 0.10, 20, 0.00, 3, 1.00, 0, 0, 1), (35, 0.00, 40, 0.00, 6, 0.00, 0, 0, 1),
    (15, 0.10, 18, 0.00, 4, 0.00, 0, 0, 1), (5, 0.00, 15, 0.10, 12, 0.00, 0, 0, 1), (4, 0.00, 12, 0.00, 30, 0.00, 0, 0, 1),
    (18, 0.00, 0, 0.00, 17, 0.00, 0, 0, 1), (22, 0.20, 25, 0.10, 11, 0.00, 0, 0, 1), (14, 0.00, 3, 1.00, 16, 0.00, 0, 0, 1),
    (50, 0.00, 60, 0.00, 80, 0.00, -1, 0, 1), (20, 0.00, 30, 0.00, 90, 0.00, -1, 0, 1), (12, 0.00, 9, 0.00, 70, 0.00, -1, 0, 1),
    (25, 0.00, 40, 0.00, 45, 0.00, -1, 0, 1), (15, 0.00, 20, 0.00, 60, 0.00, -1, 0, 1), (90, 0.00, 20, 0.00, 50, 0.00, -1, 0, 1),
    (3, 1.00, 2, 1.00, 50, 0.00, 0, 0, 0), (6, 0.80, 30, 0.00, 40, 0.00, 0, 0, 0), (2, 0.00, 2, 1.00, 1, 1.00, 0, 0, 0),
    (4, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (20, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (40, 0.00, 50, 0.00, 0, 0.00, 0, 0, 1),
    (25, 0.00, 30, 0.00, 1, 1.00, 0, 0, 1), (1, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (30, 0.10, 60, 0.00, 2, 0.50, 0, 0, 1),
    (2, 1.00, 1, 1.00, 2, 1.00, 0, 0, 0), (12, 0.90, 10, 0.80, 8, 1.00, 0, 0, 0), (5, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0),
    (8, 0.60, 40, 0.00, 10, 0.70, 0, 0, 0), (4, 0.00, 6, 0.50, 0, 0.00, 0, 0, 0), (30, 0.70, 20, 0.60, 5, 0.00, 0, 0, 0),
    (40, 0.00, 60, 0.00, 30, 0.00, 0, 1, 0), (6, 0.00, 50, 0.00, 5, 0.00, 0, 1, 0), (3, 1.00, 2, 1.00, 4, 1.00, 0, 1, 0),
    (30, 0.00, 25, 0.00, 20, 0.00, -1, 0, 1), (60, 0.00, 40, 0.00, 10, 0.00, -1, 0, 1), (18, 0.00, 50, 0.00, 35, 0.00, -1, 0, 1),
    (200, 0.00, 8, 0.00, 0, 0.00, -1, 0, 1), (120, 0.05, 5, 0.00, 70, 0.00, -1, 0, 1), (45, 0.00, 10, 0.00, 40, 0.00, -1, 0, 1),
    (25, 1.00, 40, 0.00, 40, 0.00, -1, 0, 0), (6, 0.80, 3, 1.00, 3, 1.00, -1, 0, 0), (3, 0.00, 2, 0.00, 4, 0.00, -1, 0, 0),
    (5, 0.00, 6, 0.00, 3, 0.00, -1, 0, 0), (9, 1.00, 60, 0.00, 50, 0.00, 1, 0, 0), (5, 1.00, 80, 0.00, 60, 0.00, 1, 0, 0),
    (100, 0.00, 4, 1.00, 3, 1.00, 1, 0, 1), (1, 0.00, 1, 1.00, 1, 1.00, 1, 0, 1), (80, 0.10, 90, 0.00, 30, 0.00, 1, 0, 1),
    (120, 0.00, 90, 0.00, 90, 0.00, -1, 1, 0), (200, 0.00, 10, 0.00, 20, 0.00, 0, 1, 0), (150, 0.00, 60, 0.00, 40, 0.00, 1, 1, 0),
    (40, 0.00, 0, 0.00, 30, 0.00, -1, 0, 1), (60, 0.00, 1, 0.00, 50, 0.00, -1, 0, 1), (25, 0.00, 1, 0.00, 40, 0.00, -1, 0, 1),
    (45, 0.00, 50, 0.00, 2, 1.00, -1, 0, 1), (80, 0.00, 60, 0.00, 4, 1.00, -1, 0, 1), (35, 0.00, 40, 0.00, 6, 1.00, -1, 0, 1),
    (5, 0.00, 20, 0.00, 0, 0.00, -1, 0, 0), (8, 0.00, 40, 0.00, 3, 0.00, -1, 0, 0), (10, 0.00, 60, 0.00, 2, 0.00, -1, 0, 0),
    (7, 0.00, 9, 0.00, 8, 0.00, -1, 0, 0), (9, 0.00, 30, 0.00, 12, 0.00, -1, 0, 0), (3, 0.00, 12, 0.00, 30, 0.00, -1, 0, 0),
    (30, 0.00, 6, 0.00, 25, 0.00, -1, 0, 1), (40, 0.00, 2, 0.00, 2, 0.00, -1, 0, 1), (14, 0.00, 6, 0.00, 20, 0.00, -1, 0, 1),
    (12, 0.00, 6, 0.00, 30, 0.00, 1, 0, 1), (3, 0.00, 6, 0.00, 8, 0.00, 1, 0, 1), (25, 0.00, 6, 0.00, 9, 0.00, 1, 0, 1),
    (2, 0.00, 5, 0.00, 40, 0.00, 1, 0, 1), (9, 0.00, 6, 0.50, 2, 0.00, 1, 0, 1), (18, 0.00, 6, 0.00, 14, 0.00, 0, 0, 1),
    (4, 0.00, 3, 1.00, 3, 1.00, 0, 0, 0), (3, 0.00, 4, 1.00, 5, 1.00, 0, 0, 0), (6, 0.00, 6, 0.80, 2, 1.00, 0, 0, 0),
    (2, 0.00, 3, 1.00, 25, 0.00, 0, 0, 1), (4, 0.00, 5, 1.00, 40, 0.00, 0, 0, 1), (1, 0.00, 4, 1.00, 60, 0.00, 0, 0, 1),
    (120, 0.00, 80, 0.00, 90, 0.00, 1, 0.5, 1), (40, 0.00, 30, 0.00, 60, 0.00, 1, 0.5, 1), (12, 0.00, 60, 0.00, 40, 0.00, 1, 0.5, 1), (8, 0.10, 20, 0.00, 30, 0.00, 1, 0.5, 1),
    (3, 0.00, 60, 0.00, 45, 0.00, 1, 0.5, 1), (6, 0.00, 2, 0.00, 70, 0.00, 1, 0.5, 1), (25, 0.00, 3, 0.00, 0, 0.00, 1, 0.5, 1), (4, 0.00, 30, 0.00, 20, 0.00, 1, 0.5, 1),
    (5, 1.00, 40, 0.00, 4, 1.00, 1, 0.5, 0), (3, 1.00, 2, 1.00, 3, 1.00, 1, 0.5, 0), (9, 0.80, 5, 0.90, 7, 1.00, 1, 0.5, 0), (2, 0.00, 50, 0.00, 4, 1.00, 1, 0.5, 0), (12, 0.60, 30, 0.00, 9, 0.70, 1, 0.5, 0),
    (30, 0.00, 60, 0.00, 20, 0.00, -1, 0.5, 0), (6, 0.00, 3, 0.00, 2, 1.00, -1, 0.5, 0), (4, 1.00, 4, 1.00, 4, 1.00, -1, 0.5, 0), (80, 0.00, 90, 0.00, 40, 0.00, -1, 0.5, 0), (15, 0.30, 8, 0.50, 3, 0.00, -1, 0.5, 0),
    (40, 0.00, 60, 0.00, 50, 0.00, 0, 0.5, 1), (90, 0.00, 70, 0.00, 30, 0.00, 0, 0.5, 1), (25, 0.00, 40, 0.00, 35, 0.00, 0, 0.5, 1), (5, 1.00, 60, 0.00, 3, 1.00, 0, 0.5, 0), (3, 0.00, 2, 1.00, 3, 1.00, 0, 0.5, 0), (4, 0.00, 30, 0.00, 0, 0.00, 0, 0.5, 0),
]


@dataclass(frozen=True)
class Node:
    feature: int = -1
    limit: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    keep: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A classification tree by the Gini index; of equal splits the first feature and limit."""
    if depth == 0 or y.min() == y.max():
        return Node(keep=bool(2 * y.sum() >= len(y)))
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < limit
            cost = gini(y[low]) + gini(y[~low])
            if best is None or cost < best[0] - 1e-9:
                best = cost, f, float(limit), low
    if best is None or best[0] >= gini(y) - 1e-9:
        return Node(keep=bool(2 * y.sum() >= len(y)))
    _, f, limit, low = best
    return Node(f, limit, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@functools.lru_cache(maxsize=3)
def tree(area: int) -> Node:
    """The tree of the blocks inside the main area, outside it, or of a page without one."""
    rows = np.array([row for row in LABELLED if row[6] == area], float)
    return grow(rows[:, [0, 1, 2, 3, 4, 5, 7]], rows[:, 8])


def is_main(features: tuple[float, ...], node: Node) -> bool:
    while node.feature >= 0:
        node = node.low if features[node.feature] < node.limit else node.high
    return node.keep


@dataclass
class Block:
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    main: bool = False
    mark: float = 0.0
    text: str = ""
    words: int = 0


_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_NEGATED = re.compile(r"^(?:has|with|no|without|is)[-_]", re.I)


def mark_of(tag: str, attributes: str) -> float:
    """How far an element is marked as standing beside the main text."""
    if not attributes or tag in ("html", "body", "main"):
        return 0.0
    most = 0.0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 1.0
        if name == "role" and value.lower() in BESIDE_ROLES:
            return 1.0
        if name in ("class", "id"):
            for one in value.split():
                if _NEGATED.match(one):
                    continue
                words = [w.lower() for w in _NAME_WORD.findall(one)]
                if any(w in BESIDE_WORDS for w in words):
                    most = max(most, 1.0 if all(w in BESIDE_WORDS or w in STRUCTURE_WORDS or len(w) < 3 for w in words) else 0.5)
    return most


def blocks(page: str) -> list[Block]:
    """The page's flat list of text blocks that hold text."""
    out: list[Block] = []
    stack: list[tuple[str, bool, float]] = []  # open containers: tag, inside main area, mark
    places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
    scopes: list[int] = []  # places of the open scopes
    current, main, mark, links, at = Block(), False, 0.0, 0, 0

    def add(text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        current.pieces.append(text)
        if links:
            current.linked += len(text.split())

    def drop() -> None:
        tag = stack.pop()[0]
        places[tag].pop()
        if tag in SCOPES:
            scopes.pop()

    def cut() -> None:
        nonlocal current
        if current.pieces and (words := "".join(current.pieces).split()):
            current.text, current.words = " ".join(words), len(words)
            out.append(current)
        current = Block(main=main, mark=mark)

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in DROPPED and not closing:
            if tag == "head":  # up to its end or the body's begin
                e = re.compile(r"</head\s*>|<body\b|<article\b|<main\b", re.I).search(page, at)
                at = n if e is None else e.end() if page[e.start() + 1] == "/" else e.start()
            elif not attributes.endswith("/"):
                e = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = n if e is None else e.end()
            cut() if tag in BLOCK_TAGS else None
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            current.pieces.append(" ")
        elif tag in BLOCK_TAGS or tag in CONTAINERS:
            change = tag in BLOCK_TAGS
            if closing:
                # an open element of that name in the innermost scope, else the end tag is of no effect
                at_open = places.get(tag)
                if at_open and (tag in SCOPES or at_open[-1] > (scopes[-1] if scopes else -1)):
                    i = at_open[-1]
                    change |= (stack[i - 1][1:] if i else (False, 0.0)) != (main, mark)
                    while len(stack) > i:
                        drop()
            elif tag in CONTAINERS and tag not in VOID:
                if tag in ("p", "li") and stack and stack[-1][0] == tag:
                    drop()  # its end tag may be left out
                here = stack[-1][1:] if stack else (False, 0.0)
                by_tag = tag in BESIDE_TAGS or tag == "header" and not here[0]
                marked = max(here[1], 1.0 if by_tag else mark_of(tag, attributes))
                is_area = here[0] or tag in ("article", "main") or 'role="main"' in attributes
                change |= (is_area, marked) != (main, mark)
                places.setdefault(tag, []).append(len(stack))
                if tag in SCOPES:
                    scopes.append(len(stack))
                stack.append((tag, is_area, marked))
            if change:
                links = 0 if tag in SCOPES else links
                cut()
            main, mark = stack[-1][1:] if stack else (False, 0.0)
            current.main, current.mark = main, mark
    cut()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    area = any(b.main and b.mark < 1 for b in found)
    size = [(b.words, min(1.0, b.linked / b.words)) for b in found]
    around = [(0, 0.0), *size, (0, 0.0)]
    place = [(1 if b.main else -1) if area else 0 for b in found]
    kept = [b.text for i, b in enumerate(found) if is_main((*around[i + 1], *around[i], *around[i + 2], b.mark), tree(place[i]))]
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """id_col, url, text, n_chars for every row: a map without a shuffle."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [id_col, url, "text", "n_chars"])

    return pages.select(id_col, url, page).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{url}` {kinds[url]}, text string, n_chars bigint")
