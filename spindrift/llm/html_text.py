"""Main text of web pages by shallow features of flat text blocks.

A page is read as a flat run of text blocks: block-level tags end a block, inline tags do not. Each block has
its number of words, link density (words inside links), the same of its neighbours, and where it stands:
inside how many elements that hold furniture by their tag or role, inside how many whose class or id names furniture, and inside an
article or not. A name counts if all of its words are names of furniture or of boxes: `cookie-notice` does, `social-science` and
`ad-free-notes` do not. A small decision tree, grown (Gini, as CART) on the labelled table below, tells main text from the rest;
no block is left out before the tree sees it. The name is one of its features: in an article a named box of many words without
links is text. Where a page marks neither furniture nor article, words and link densities decide.

Defined cases: null html counts as empty and gives an empty text with 0 characters; unclosed and stray tags,
comments, and a page that breaks off are read as browsers do, near enough; repeated rows each give a row;
null ids and urls are carried; an empty table gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The block-level elements, those whose content is no text, and those that hold furniture.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead title tr ul caption".split()
)
SILENT_TAGS = frozenset("script style noscript template title head svg math textarea select option button iframe object canvas audio video datalist input".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu header dialog".split())
CONTAINER_TAGS = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form header li main menu nav ol section table tbody td th tr ul".split())
PARAGRAPH_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd address".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header menu meta modal nav navbar "
    "navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tags teaser toc toolbar widget widgets".split()
)
#: Words of names that say nothing of what a box holds.
BOX_WORDS = frozenset("area bar bg block body bottom box btn button card col column container fixed global group holder inner item items left level link links list middle outer page panel right row section site small sticky text title top unit wrap wrapper".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

TAG = re.compile(
    r"""<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.DOTALL,
)
HINTS = re.compile(r"""(?<![^\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORD_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: int
    article: int
    heading: int
    named: int = 0
    features: list[float] = field(default_factory=list)


def names_furniture(value: str, in_article: bool) -> bool:
    """Whether some name of a class or id is made of words for furniture and boxes, the former at least once."""
    for name in value.split():
        words = {w.lower() for w in WORD_OF_NAME.findall(name)}
        furniture = words & FURNITURE_WORDS - ({"header"} if in_article else set())
        if furniture and all(w in FURNITURE_WORDS or w in BOX_WORDS or len(w) == 1 for w in words):
            return True
    return False


def marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element holds furniture by its tag, role or being hidden, and whether its class or id names furniture."""
    furniture, named = tag in FURNITURE_TAGS and not (tag == "header" and in_article), False
    for name, a, b, c in HINTS.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role":
            furniture |= value.lower() in FURNITURE_ROLES
        elif name in ("hidden", "aria-hidden"):
            furniture |= name == "hidden" or value.lower() == "true"
        elif tag not in ("body", "html", "article", "main"):
            named |= names_furniture(value, in_article)
    return furniture, named


class Reader:
    """Gathers the flat text blocks of a page from its tags and texts, in page order."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []  # open containers: tag, furniture, named so, article
        self.open: Counter[str] = Counter()  # how many of each are on the stack
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.furniture = self.named = self.article = 0
        self.paragraph, self.heading = (False, False), False  # marks of an open paragraph itself; an open heading
        self.link = -1  # how many containers were open where the open link begins
        self.aside: tuple[list[str], list[str], int, tuple[bool, bool]] | None = None  # what an inline piece of furniture interrupts, spans open in it, its marks

    def text(self, piece: str) -> None:
        piece = html.unescape(piece)
        self.parts.append(piece)
        if self.link >= 0:
            self.linked.append(piece)

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            inline = self.aside[3] if self.aside else (False, False)
            furniture, named = (own + self.paragraph[k] + inline[k] for k, own in enumerate((self.furniture, self.named)))
            self.out.append(Block(text, text.count(" ") + 1, len("".join(self.linked).split()), furniture, self.article, int(self.heading), named))
        self.parts, self.linked = [], []

    def end_aside(self) -> None:
        if self.aside:
            self.end_block()
            self.parts, self.linked = self.aside[:2]
            self.aside = None

    def span(self, closing: bool, attrs: str) -> None:
        if self.aside:
            parts, linked, depth, own = self.aside
            depth += -1 if closing else 1
            self.aside = (parts, linked, depth, own)
            if not depth:
                self.end_aside()
        elif not closing and attrs and any(own := marks("span", attrs, self.article > 0)):
            self.aside = (self.parts, self.linked, 1, own)
            self.parts, self.linked = [], []

    def block_tag(self, name: str, closing: bool, attrs: str) -> None:
        self.end_aside()
        self.end_block()
        self.paragraph, self.heading = (False, False), False
        if name in CONTAINER_TAGS and closing:
            while self.open[name]:
                tag, furniture, named, article = self.stack.pop()
                self.open[tag] -= 1
                self.furniture -= furniture
                self.named -= named
                self.article -= article
                if tag == name:
                    break
            if self.link > len(self.stack):
                self.link = -1
        elif name in CONTAINER_TAGS:
            entry = name, *marks(name, attrs, self.article > 0), name in ("article", "main")
            self.stack.append(entry)
            self.open[name] += 1
            self.furniture += entry[1]
            self.named += entry[2]
            self.article += entry[3]
        elif name in PARAGRAPH_TAGS and not closing:
            self.heading = name[0] == "h"
            self.paragraph = marks(name, attrs, self.article > 0) if attrs else (False, False)


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in page order; each character is passed once."""
    reader, at, end = Reader(), 0, len(page)
    while at <= end:
        m = TAG.search(page, at)
        if piece := page[at : m.start() if m else end]:
            reader.text(piece)
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        closing, attrs = bool(m["close"] or m["close2"]), m["attrs"] or m["attrs2"] or ""
        if name == "a":
            reader.link = -1 if closing else len(reader.stack)
        elif name == "span":
            reader.span(closing, attrs)
        elif name in SILENT_TAGS:
            if not closing and name not in VOID_TAGS and name != "head" and not attrs.endswith("/"):
                # what is inside is passed over up to its own closing tag
                stop = closing_tag(name).search(page, at)
                at = stop.end() if stop else end + 1
        elif name in BLOCK_TAGS:
            if name in VOID_TAGS:
                reader.text(" ")
            reader.block_tag(name, closing, attrs)
        elif name == "br":
            reader.text(" ")
    reader.end_aside()
    reader.end_block()
    return reader.out


@functools.cache
def closing_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE)


#: Words, link density, words and link density of the block before and of the one after, containers of
#: furniture around it, articles around it, heading or not; whether such a block is main text. No names in these.
UNNAMED = (
    ((85, 0.0, 60, 0.0, 70, 0.0, 0, 1, 0), 1), ((40, 0.0, 8, 0.0, 55, 0.0, 0, 1, 0), 1), ((8, 0.0, 3, 1.0, 40, 0.0, 0, 1, 1), 1), ((1, 0.0, 30, 0.0, 45, 0.0, 0, 1, 0), 1),
    ((2, 0.0, 1, 0.0, 2, 0.0, 0, 1, 0), 1), ((120, 0.05, 90, 0.0, 4, 0.0, 0, 1, 0), 1), ((12, 0.3, 80, 0.0, 60, 0.1, 0, 1, 0), 1), ((25, 0.0, 70, 0.0, 3, 1.0, 0, 1, 0), 1),
    ((3, 0.0, 75, 0.0, 10, 0.0, 0, 1, 0), 1), ((5, 0.0, 6, 0.0, 7, 0.0, 0, 1, 0), 1), ((9, 1.0, 50, 0.0, 44, 0.0, 0, 1, 0), 1), ((4, 0.0, 0, 0.0, 20, 0.0, 0, 1, 1), 1),
    ((2, 0.0, 40, 0.0, 1, 1.0, 0, 1, 0), 1), ((6, 0.0, 35, 0.0, 2, 1.0, 0, 1, 0), 1), ((14, 0.0, 3, 1.0, 2, 1.0, 0, 1, 0), 1), ((1, 0.0, 1, 1.0, 1, 1.0, 0, 1, 0), 1),
    ((3, 1.0, 50, 0.0, 2, 1.0, 0, 1, 0), 1), ((2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0), 1), ((4, 0.5, 2, 0.0, 3, 0.0, 0, 1, 0), 1), ((1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0), 1),
    ((60, 0.02, 50, 0.0, 45, 0.0, 0, 2, 0), 1), ((18, 0.0, 22, 0.0, 0, 0.0, 0, 2, 0), 1),
    ((90, 0.0, 10, 0.0, 80, 0.0, 0, 0, 0), 1), ((45, 0.03, 60, 0.0, 50, 0.0, 0, 0, 0), 1), ((30, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0), 1), ((14, 0.0, 55, 0.0, 62, 0.0, 0, 0, 0), 1),
    ((7, 0.0, 0, 0.0, 48, 0.0, 0, 0, 1), 1), ((5, 0.0, 38, 0.0, 52, 0.0, 0, 0, 1), 1), ((22, 0.1, 35, 0.0, 41, 0.0, 0, 0, 0), 1), ((3, 0.0, 44, 0.0, 66, 0.0, 0, 0, 0), 1),
    ((1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), 0), ((2, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0), 0), ((6, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0), 0), ((9, 0.1, 70, 0.0, 0, 0.0, 1, 0, 0), 0),
    ((35, 0.0, 1, 1.0, 40, 0.0, 1, 0, 0), 0), ((60, 0.0, 55, 0.0, 50, 0.0, 1, 0, 0), 0), ((28, 0.0, 80, 0.0, 75, 0.0, 1, 1, 0), 0), ((5, 0.0, 66, 0.0, 59, 0.0, 1, 1, 0), 0),
    ((4, 0.0, 20, 0.0, 30, 0.0, 1, 1, 1), 0), ((15, 0.0, 12, 0.0, 18, 0.0, 2, 1, 0), 0), ((3, 1.0, 2, 1.0, 4, 1.0, 2, 1, 0), 0), ((50, 0.0, 5, 0.0, 6, 0.0, 2, 0, 0), 0),
    ((11, 0.0, 4, 0.0, 3, 0.0, 2, 0, 0), 0), ((7, 0.0, 9, 0.0, 1, 1.0, 1, 0, 1), 0), ((100, 0.02, 90, 0.0, 85, 0.0, 1, 0, 0), 0), ((80, 0.0, 70, 0.0, 0, 0.0, 1, 1, 0), 0),
    ((2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0), 0), ((1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), 0), ((3, 1.0, 1, 1.0, 60, 0.0, 0, 0, 0), 0), ((5, 0.8, 4, 1.0, 3, 1.0, 0, 0, 0), 0),
    ((12, 0.9, 40, 0.0, 2, 1.0, 0, 0, 0), 0), ((20, 0.7, 15, 0.8, 18, 0.9, 0, 0, 0), 0), ((2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), 0), ((4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), 0),
    ((3, 0.0, 5, 0.9, 2, 0.8, 0, 0, 0), 0), ((6, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0), 0),
    ((2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), 1), ((9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0), 1), ((4, 0.0, 0, 0.0, 12, 0.0, 0, 0, 0), 1), ((70, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0), 1), ((12, 0.1, 4, 0.0, 15, 0.0, 0, 0, 0), 1),
    ((3, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0), 1), ((28, 0.2, 2, 1.0, 33, 0.0, 0, 0, 0), 1), ((50, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0), 1), ((16, 0.0, 1, 1.0, 40, 0.0, 0, 0, 0), 1), ((60, 0.15, 3, 1.0, 55, 0.1, 0, 0, 0), 1),
    ((45, 0.9, 2, 1.0, 50, 0.0, 0, 0, 0), 0), ((80, 0.8, 60, 0.0, 3, 1.0, 0, 0, 0), 0), ((30, 1.0, 0, 0.0, 40, 0.0, 0, 0, 0), 0), ((55, 0.7, 70, 0.1, 0, 0.0, 0, 0, 0), 0), ((65, 0.6, 30, 1.0, 25, 0.9, 0, 0, 0), 0),
    ((1, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0), 0), ((5, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0), 0), ((2, 1.0, 60, 0.0, 0, 0.0, 0, 0, 0), 0), ((1, 1.0, 45, 0.0, 1, 1.0, 0, 0, 0), 0), ((10, 0.6, 0, 0.0, 90, 0.0, 0, 0, 0), 0),
)


#: The same inside one or two boxes named as furniture, with their number at the end.
NAMED = (
    ((30, 0.0, 1, 1.0, 80, 0.0, 0, 0, 0, 1), 0), ((9, 0.0, 12, 0.0, 1, 1.0, 0, 0, 0, 1), 0), ((80, 0.0, 6, 0.0, 75, 0.0, 0, 0, 0, 1), 0), ((140, 0.0, 90, 0.0, 70, 0.0, 0, 0, 0, 2), 0),
    ((2, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0, 1), 0), ((6, 0.0, 30, 0.0, 55, 0.0, 0, 0, 1, 1), 0), ((45, 0.1, 0, 0.0, 20, 0.0, 0, 0, 0, 1), 0), ((65, 0.0, 50, 0.0, 0, 0.0, 0, 0, 0, 1), 0),
    ((100, 0.0, 3, 0.0, 95, 0.0, 0, 0, 0, 1), 0), ((12, 0.5, 4, 1.0, 3, 1.0, 0, 0, 0, 2), 0), ((75, 0.2, 60, 0.0, 50, 0.0, 0, 0, 0, 1), 0), ((18, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1), 0),
    ((9, 0.0, 60, 0.0, 55, 0.0, 0, 1, 0, 1), 0), ((3, 1.0, 70, 0.0, 45, 0.0, 0, 1, 0, 1), 0), ((20, 0.0, 52, 0.0, 48, 0.0, 0, 1, 0, 1), 0), ((5, 0.0, 44, 0.0, 30, 0.0, 0, 1, 1, 1), 0),
    ((28, 0.2, 65, 0.0, 80, 0.0, 0, 1, 0, 1), 0), ((14, 0.0, 4, 1.0, 90, 0.0, 0, 1, 0, 2), 0), ((70, 0.8, 55, 0.0, 60, 0.0, 0, 1, 0, 1), 0), ((85, 0.5, 40, 0.0, 50, 0.0, 0, 1, 0, 1), 0),
    ((35, 0.0, 50, 0.0, 42, 0.0, 0, 1, 0, 1), 0), ((38, 0.1, 90, 0.0, 66, 0.0, 0, 1, 0, 1), 0),
    ((75, 0.0, 60, 0.0, 82, 0.0, 0, 1, 0, 1), 1), ((110, 0.0, 95, 0.0, 70, 0.0, 0, 1, 0, 1), 1), ((68, 0.05, 80, 0.0, 58, 0.0, 0, 1, 0, 1), 1), ((90, 0.0, 8, 0.0, 100, 0.0, 0, 1, 0, 1), 1), ((130, 0.0, 70, 0.0, 0, 0.0, 0, 2, 0, 1), 1),
)
LABELLED = (*(((*x, 0), y) for x, y in UNNAMED), *NAMED)


@dataclass
class Node:
    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """A binary decision tree by Gini impurity; of equal splits the first feature and lowest cut."""
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
        return node
    best = (len(y) * node.share * (1 - node.share) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            n = int(low.sum())
            if min(n, len(y) - n) < least:
                continue
            p, q = y[low].mean(), y[~low].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if impurity < best[0]:
                best = (impurity, f, float(cut))
    if best[1] < 0:
        return node
    _, node.feature, node.cut = best
    low = x[:, node.feature] < node.cut
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def decide(node: Node, features: list[float]) -> bool:
    while node.feature >= 0:
        node = node.low if features[node.feature] < node.cut else node.high
    return node.share >= 0.5


@functools.cache
def tree(labelled: tuple = LABELLED) -> Node:
    return grow(np.array([x for x, _ in labelled], float), np.array([y for _, y in labelled], float))


def main_text(page: str | None, root: Node) -> str:
    found = blocks(page or "")
    density = [b.linked / b.words for b in found]
    texts = []
    for i, b in enumerate(found):
        before = (found[i - 1].words, density[i - 1]) if i else (0, 0.0)
        after = (found[i + 1].words, density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        if decide(root, [b.words, density[i], *before, *after, b.furniture, b.article, b.heading, b.named]):
            texts.append(b.text)
    return "\n".join(texts)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple = LABELLED) -> DataFrame:
    """One row per page: id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = tree(labelled)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                some = b.slice(k, 500)
                texts = [main_text(x, root) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
