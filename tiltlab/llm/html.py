"""Main text of web pages from flat blocks, classified by a decision tree.

A page is read in one pass by the standard library's tokenizer into a flat list of text blocks: block-level tags end a block,
inline tags do not; scripts, styles and other unseen content never enter one. A block has its text, word count, link
density and the words and link density of its neighbours, whether a heading, and what its enclosing elements say: furniture
(navigation, header, footer, sidebar, form, ...), names that mark adverts, notices and the like, names that mark comments, or main content.
Marked blocks are boilerplate at any length. A name marks
if it says nothing else (``has-sidebar`` or ``tag-legal`` say something else), and never counts on a main element, on the page's article (the longest) or
on what encloses them, except that names of comments count around articles. A decision
tree over these features tells content from boilerplate; it is trained here, on the small labelled table ``LABELLED``.

Scripts and the like end where their end tag stands, so a ``</p>`` inside a script is script. Unclosed elements end with
the closest enclosing element that is closed. Character references are decoded once.

Defined results: a null or empty page, or one without content blocks, has empty text; malformed markup is read as far as it goes;
white space inside a block is one space; blocks are trimmed and joined by two line feeds; equal rows get equal
results; null ids are kept; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tiltlab.llm import tokens as T

# Element and attribute names of HTML, by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template svg canvas iframe object audio video head title select option datalist math textarea button".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul br".split()
)
FURNITURE = frozenset("nav header footer aside form menu dialog search fieldset".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An opening tag ends an open element of these kinds first.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
# A class or id marks its element if one whole name of it consists of these words, alone or with neutral parts ("cookie-banner", "comment-list", "ad_1").
COMMENTS = frozenset("comment comments disqus reply replies respond discussion".split())
MARKS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner notice cookie cookies consent gdpr popup modal overlay "
    "sidebar related recommended share sharing subscribe subscription newsletter signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead footer copyright disclaimer skip toc".split()
)
NEUTRAL = frozenset("area bar block body bottom box buttons container form inner item left link links list message module outer panel posts right section site slot thread top unit wrap wrapper".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "heading", "furniture", "marked", "comments", "main")

# The labelled table: features of blocks in the order of FEATURES, and whether the block is content.
LABELLED = (
    # menus, headers, footers and forms
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0, 0, 0),
    (2, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 0, 0),
    (1, 1.0, 2, 1.0, 14, 0.0, 0, 1, 0, 0, 0, 0),
    (4, 0.5, 1, 1.0, 40, 0.0, 0, 1, 0, 0, 0, 0),
    (12, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 0),
    (40, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0, 0, 0, 0),
    (9, 0.1, 30, 0.0, 5, 0.2, 0, 1, 0, 0, 1, 0),
    (25, 0.0, 70, 0.0, 20, 0.0, 0, 1, 0, 0, 1, 0),
    (3, 0.0, 20, 0.0, 1, 0.0, 1, 1, 0, 0, 0, 0),
    (6, 0.0, 90, 0.0, 2, 0.0, 0, 1, 1, 0, 0, 0),
    # adverts, notices and comments, wherever they stand
    (8, 0.0, 1, 1.0, 14, 0.0, 0, 0, 0, 1, 0, 0),
    (20, 0.0, 1, 1.0, 12, 0.0, 0, 0, 1, 0, 0, 0),
    (35, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 1, 1, 0),
    (60, 0.0, 50, 0.0, 30, 0.0, 0, 0, 1, 0, 1, 0),
    (15, 0.3, 45, 0.0, 45, 0.0, 0, 0, 0, 1, 1, 0),
    (2, 0.0, 15, 0.0, 40, 0.0, 1, 0, 1, 0, 1, 0),
    (120, 0.0, 20, 0.0, 90, 0.0, 0, 0, 0, 1, 0, 0),
    (4, 1.0, 60, 0.0, 50, 0.0, 0, 0, 1, 0, 1, 0),
    # content in an article
    (7, 0.0, 20, 0.0, 60, 0.0, 1, 0, 0, 0, 1, 1),
    (2, 0.0, 1, 1.0, 30, 0.0, 1, 0, 0, 0, 1, 1),
    (1, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 1, 1),
    (30, 0.0, 7, 0.0, 40, 0.0, 0, 0, 0, 0, 1, 1),
    (90, 0.1, 30, 0.0, 12, 0.0, 0, 0, 0, 0, 1, 1),
    (55, 0.0, 90, 0.1, 12, 0.2, 0, 0, 0, 0, 1, 1),
    (3, 1.0, 50, 0.0, 60, 0.0, 0, 0, 0, 0, 1, 1),
    (6, 0.8, 80, 0.0, 0, 0.0, 0, 0, 0, 0, 1, 1),
    (18, 0.3, 40, 0.2, 22, 0.4, 0, 0, 0, 0, 1, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1, 1),
    (50, 0.0, 40, 0.0, 1, 1.0, 0, 0, 0, 0, 1, 1),
    (2, 1.0, 3, 1.0, 4, 1.0, 0, 0, 0, 0, 1, 1),
    (12, 0.9, 3, 1.0, 8, 0.9, 0, 0, 0, 0, 1, 1),
    (25, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 1, 1),
    # pages without an article element
    (40, 0.0, 2, 0.0, 45, 0.0, 0, 0, 0, 0, 0, 1),
    (60, 0.1, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 1),
    (16, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 0, 0, 1),
    (5, 0.0, 2, 1.0, 40, 0.0, 1, 0, 0, 0, 0, 1),
    (9, 0.0, 50, 0.0, 60, 0.0, 1, 0, 0, 0, 0, 1),
    (3, 0.0, 45, 0.0, 70, 0.0, 0, 0, 0, 0, 0, 1),
    (10, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (45, 0.0, 30, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 1),
    (30, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 1),
    (14, 0.1, 6, 0.9, 3, 1.0, 0, 0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0, 0),
    (1, 1.0, 2, 1.0, 30, 0.0, 0, 0, 0, 0, 0, 0),
    (6, 0.8, 70, 0.0, 50, 0.0, 0, 0, 0, 0, 0, 0),
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0, 0),
    (8, 0.9, 1, 1.0, 3, 1.0, 0, 0, 0, 0, 0, 0),
    (4, 0.7, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (12, 0.8, 40, 0.0, 6, 0.9, 0, 0, 0, 0, 0, 0),
    # long adverts, notices, sidebars and comments, and long lists of links
    (150, 0.0, 90, 0.0, 130, 0.0, 0, 0, 0, 1, 1, 0),
    (220, 0.1, 150, 0.0, 12, 0.2, 0, 0, 1, 0, 1, 0),
    (180, 0.0, 6, 0.0, 160, 0.0, 0, 0, 0, 1, 0, 0),
    (300, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0),
    (160, 0.7, 90, 0.0, 2, 1.0, 0, 0, 0, 1, 0, 0),
    (240, 0.9, 150, 0.0, 60, 0.0, 0, 0, 1, 0, 1, 0),
    # long running text that no name marks
    (150, 0.0, 90, 0.0, 130, 0.0, 0, 0, 0, 0, 1, 1),
    (220, 0.1, 150, 0.0, 12, 0.2, 0, 0, 0, 0, 1, 1),
    (180, 0.0, 6, 0.0, 160, 0.0, 0, 0, 0, 0, 0, 1),
    (300, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (2500, 0.0, 60, 0.0, 900, 0.0, 0, 0, 0, 0, 1, 1),
    # paragraphs with many links
    (40, 0.4, 30, 0.0, 50, 0.1, 0, 0, 0, 0, 0, 1),
    (25, 0.3, 60, 0.2, 0, 0.0, 0, 0, 0, 0, 0, 1),
    (12, 0.4, 40, 0.1, 45, 0.3, 0, 0, 0, 0, 0, 1),
    (70, 0.4, 0, 0.0, 30, 0.4, 0, 0, 0, 0, 0, 1),
)


@dataclass
class Node:
    """A split of the tree, or a leaf if ``feature`` is negative."""

    feature: int
    bound: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None
    share: float = 0.0


def train_tree(table: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """Greedy Gini splits at midpoints; ties go to the earlier feature and lower bound."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return Node(-1, share=share)
    best: tuple[float, int, float] | None = None
    for feature in range(table.shape[1]):
        values = np.unique(table[:, feature])
        for bound in (values[1:] + values[:-1]) / 2:
            left = table[:, feature] <= bound
            if min(left.sum(), (~left).sum()) < least:
                continue
            impurity = sum(part.sum() * 2 * labels[part].mean() * (1 - labels[part].mean()) for part in (left, ~left))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(bound))
    if best is None or best[0] >= len(labels) * 2 * share * (1 - share) - 1e-12:
        return Node(-1, share=share)
    _, feature, bound = best
    left = table[:, feature] <= bound
    return Node(feature, bound, train_tree(table[left], labels[left], depth - 1, least), train_tree(table[~left], labels[~left], depth - 1, least), share)


def is_content(tree: Node, row: tuple) -> bool:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.bound else tree.high
    return tree.share >= 0.5


def default_tree() -> Node:
    table = np.array(LABELLED, float)
    return train_tree(table[:, :-1], table[:, -1])


@dataclass
class Block:
    text: str
    words: int
    links: float
    heading: bool
    furniture: bool
    marked: bool
    comments: bool
    main: bool


def mark_of(names: str) -> str:
    """The kind of mark in a class or id attribute: "comments", "other" or none."""
    for name in names.lower().split():
        parts = [x for x in re.split("[_-]+", name) if x and not x.isdigit()]
        if any(x in MARKS for x in parts) and all(x in MARKS or x in NEUTRAL for x in parts):
            return "comments" if any(x in COMMENTS for x in parts) else "other"
    return ""


@dataclass
class _Mark:
    kind: str
    lifted: bool = False


@dataclass
class _Article:
    """An article outside any other; ``marks`` are its own and those of the elements around it."""

    marks: tuple
    words: int = 0


@dataclass
class _Open:
    tag: str
    unseen: bool
    furniture: bool
    marks: tuple
    article: _Article | None
    main: bool
    heading: bool
    link: bool
    parts: list = field(default_factory=list)


class BlockReader(HTMLParser):
    """Flat blocks of one page."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open = [_Open("", False, False, (), None, False, False, False)]
        self.articles: list[_Article] = []
        self.marks: list[tuple] = []  # of each block, until the page's end tells which count
        self.owners: list[_Article | None] = []
        self.text: list[str] = []
        self.linked = 0
        self.context = self.open[0]

    def _end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            words = text.count(" ") + 1
            c = self.context
            self.blocks.append(Block(text, words, min(1.0, self.linked / words), c.heading, c.furniture, False, False, c.main))
            self.marks.append(c.marks)
            self.owners.append(c.article)
            if c.article:
                c.article.words += words
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attributes):
        if tag in BLOCKS:
            self._end_block()
        ends = ENDS.get(tag)
        while ends and len(self.open) > 1 and self.open[-1].tag in ends:
            self.open.pop()
        if tag in VOID:
            return
        if tag == "p":  # a paragraph also ends inline elements left open in the one before
            at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag in BLOCKS), 0)
            if at and self.open[at].tag == "p":
                del self.open[at:]
        up = self.open[-1]
        named = dict(attributes)
        names = f"{named.get('class') or ''} {named.get('id') or ''}"
        role = (named.get("role") or "").lower()
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        header_of_article = tag == "header" and up.main
        kind = "" if tag in ("body", "html") else mark_of(names)
        marks = (*up.marks, _Mark(kind)) if kind else up.marks
        if tag == "main" or role == "main":
            for mark in marks:
                mark.lifted = True
        article = up.article
        if tag == "article" and not article:
            article = _Article(marks)
            self.articles.append(article)
        self.open.append(
            _Open(
                tag,
                up.unseen or tag in UNSEEN or hidden,
                up.furniture or (tag in FURNITURE and not header_of_article) or role in ROLES,
                marks,
                article,
                up.main or tag in CONTENT or role == "main",
                up.heading or tag in HEADINGS,
                up.link or tag == "a",
            )
        )

    def handle_startendtag(self, tag, attributes):
        self.handle_starttag(tag, attributes)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self._end_block()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        up = self.open[-1]
        if up.unseen:
            return
        if not self.text:
            self.context = up
        self.text.append(data)
        if up.link:
            self.linked += len(data.split())

    def finish(self, page: str) -> list[Block]:
        self.feed(page)
        if re.match(r"</?[a-zA-Z!]", self.rawdata):  # a tag or comment that the page's end cuts off
            self.rawdata = ""
        self.close()
        self._end_block()
        # The page's article is the longest, if no more unmarked text stands outside it; what it or a main element stands in
        # is no furniture, whatever its name.
        page = max(self.articles, key=lambda a: a.words, default=None)
        rest = sum(b.words for b, marks, owner in zip(self.blocks, self.marks, self.owners, strict=True) if owner is not page and not b.furniture and all(m.lifted for m in marks))
        if page and page.words >= rest:
            for mark in page.marks:
                mark.lifted |= mark.kind != "comments"
        for block, marks in zip(self.blocks, self.marks, strict=True):
            kinds = {mark.kind for mark in marks if not mark.lifted}
            block.marked, block.comments = "other" in kinds, "comments" in kinds
        return self.blocks


def features(blocks: list[Block]) -> list[tuple]:
    none = Block("", 0, 0.0, False, False, False, False, False)
    rows = []
    around = [none, *blocks, none]
    for before, block, after in zip(around, blocks, around[2:]):
        rows.append((block.words, block.links, before.words, before.links, after.words, after.links, block.heading, block.furniture, block.marked, block.comments, block.main))
    return rows


def main_text(page: str, tree: Node) -> str:
    blocks = BlockReader().finish(page)
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks), strict=True) if is_content(tree, row))


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(tree or default_tree())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in T.pieces(batches, "html"):
            texts = [main_text(page, shared.value) if page else "" for page in piece.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
