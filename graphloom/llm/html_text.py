"""Main text of web pages by text-to-tag ratio over streaming parser events.

1. The standard library's parser streams tags and text.  A line is what stands between two
   block boundaries; it remembers its place among the elements that are open.
2. Elements that say what they are go first: navigation, headers outside the article, footers,
   asides, forms, scripts, and elements whose class, id or role names a menu, a sidebar, a
   notice, an advert or reader comments.
3. Each other line has a ratio, its characters outside links for each tag.  The ratios are
   smoothed by a Gaussian along the page and split in two clusters; lines of the upper one are
   the core of content regions.
4. A region is the article or main element that holds core lines; on pages without one, the
   deepest element that holds most of the core.  Short lines inside a region stay.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import attach

SIGMA, RADIUS = 1.0, 2
#: Share of the core that a region holds on pages without an article.
MOST = 0.8
#: Clusters whose means differ by less than this factor are one.
APART = 1.5

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe legend li main menu nav noscript object ol optgroup option p pre script search section select style summary svg table tbody td template textarea tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never part of a text, wherever they stand.
SILENT = frozenset("aside audio button canvas datalist dialog embed head iframe menu nav noscript object script search select style svg template textarea title video footer".split())
#: What an open element of one kind is closed by.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that an implied end does not reach beyond.
SCOPES = frozenset("article aside body dl form html main menu nav ol section table ul".split())
IN_HEAD = frozenset("head html base link meta noscript script style template title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promoted promotion sponsor sponsored "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination footer colophon sidebar sidebars aside widget widgets related recommended trending "
    "cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup login search form "
    "comment comments disqus discussion replies respond responses share sharing social".split()
)
OUTSIDE_NAMES = frozenset("header masthead topbar".split())
COMMENT_NAMES = frozenset("comment comments disqus discussion replies respond responses".split())
NEGATING = frozenset("has is no not with without".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
COMMENT_HEADING = re.compile(r"(\d+ )?(reader |user )?(comments?|commentaires?|kommentare?|comentarios?|leave a (reply|comment))\b.{0,20}", re.IGNORECASE)


class Node:
    """An open element: what it says of itself, and what its ancestors said."""

    __slots__ = ("parent", "tag", "goes", "may_go", "content", "main", "out", "link", "depth", "block", "inside", "barred", "doubted", "mass", "outer", "branch")

    def __init__(self, parent: Node | None, tag: str):
        self.parent, self.tag = parent, tag
        self.goes = self.may_go = self.content = self.main = self.out = False
        self.link = tag == "a" or parent is not None and parent.link
        self.depth = parent.depth + 1 if parent else 0
        self.block: Node = self if parent is None or tag in BLOCKS else parent.block
        #: Inside a main element; something that never holds content; something that may go.
        self.inside = parent is not None and (parent.inside or parent.main)
        self.barred = parent is not None and (parent.barred or parent.goes or parent.content is None)
        self.doubted = parent is not None and (parent.doubted or parent.may_go)


class Line:
    __slots__ = ("node", "parts", "tags", "text", "ratio")

    def __init__(self, node: Node, tags: int):
        self.node, self.tags, self.parts = node, tags, []
        self.text, self.ratio = "", 0.0


class Events(HTMLParser):
    """Lines of one page, each with the element that it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node(None, "#")
        self.nodes = [self.root]
        self.lines: list[Line] = []
        self.line: Line | None = None
        self.tags, self.ending = 0, False
        self.open: Counter[str] = Counter()
        self.clear = False  # whether a main element stands in nothing that may go

    # the page may end inside a comment or a tag: what is left is part of it
    def parse_comment(self, i, report=1):
        k = super().parse_comment(i, report)
        return len(self.rawdata) if k < 0 and self.ending else k

    def parse_starttag(self, i):
        k = super().parse_starttag(i)
        return len(self.rawdata) if k < 0 and self.ending else k

    def parse_endtag(self, i):
        k = super().parse_endtag(i)
        return len(self.rawdata) if k < 0 and self.ending else k

    def read(self, html: str) -> list[Line]:
        self.ending = True  # the whole page is there
        self.feed(html)
        self.close()
        return self.lines

    def end(self, node: Node) -> None:
        """Close an open element with all that is open inside it."""
        while self.at is not node.parent:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def close_open(self, tags: tuple[str, ...]) -> None:
        """End the innermost open element of these kinds, if no scope begins inside it."""
        if not any(self.open[tag] for tag in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in tags:
            if node.tag in SCOPES:
                return
            node = node.parent
        if node.parent is not None:
            self.end(node)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.handle_data(" ")
            return
        if tag in BLOCKS:
            self.line = None
            if tag not in IN_HEAD and self.open["head"]:
                while self.open["head"]:
                    self.end(self.at)
            self.close_open(("p", *HEADINGS) if tag in HEADINGS else ("p",))
            if tag in CLOSED_BY:
                self.close_open(CLOSED_BY[tag])
        if tag in VOID:
            return
        node = self.at = Node(self.at, tag)
        self.open[tag] += 1
        self.nodes.append(node)
        self.judge(node, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path", "iframe") and self.at.tag == tag:
            self.end(self.at)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.line = None
        if not self.open[tag]:
            return
        node = self.at
        while node.tag != tag:
            if tag not in BLOCKS and node.tag in BLOCKS:
                return  # an inline end tag does not end a block
            node = node.parent
        self.end(node)

    def handle_data(self, data):
        if self.line is None:
            if not data.strip():
                return
            self.line = Line(self.at.block, self.tags)
            self.lines.append(self.line)
            self.tags = 0
        self.line.parts.append((self.at, data))

    def judge(self, node: Node, attrs: list[tuple[str, str | None]]) -> None:
        """What an element says of itself: whether it goes, may go, or holds the content."""
        tag, inside = node.tag, node.inside
        node.goes = tag in SILENT or tag == "header" and not inside
        node.may_go = tag == "form"
        names: list[str] = []
        for key, value in attrs:
            value = value or ""
            if key in ("class", "id"):
                for word in value.split():
                    parts = [p.lower() for p in NAME_PARTS.findall(word)]
                    if not NEGATING.intersection(parts):
                        names += parts
            elif key == "role":
                node.may_go |= value.strip().lower() in ROLES
                node.main |= value.strip().lower() == "main"
            elif key == "itemprop":
                node.main |= value == "articleBody"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                node.goes = True
        if tag in ("html", "body"):
            node.goes = node.may_go = False
            return
        node.may_go |= not NAMES.isdisjoint(names) or not inside and not OUTSIDE_NAMES.isdisjoint(names)
        comment = not COMMENT_NAMES.isdisjoint(names)
        node.main = (node.main or tag in ("main", "article")) and not node.may_go
        if node.barred:
            node.main = False
            return
        self.clear |= node.main and not node.doubted
        above = node.parent if node.main else None
        while above is not None and above.content is False:
            above.content = True
            above = above.parent
        if comment:
            node.content = None  # never taken for content, whatever is inside


def settle(lines: list[Line], nodes: list[Node], trusting: bool, clear: bool) -> None:
    """Mark what is out, with all that is inside it, and give the lines their text and ratio.

    trusting: what may go goes, but for what holds the only main elements (clear: there are others)."""
    for node in nodes:  # parents come first
        above = node.parent
        node.out = above is not None and (above.out or node.goes or trusting and node.may_go and (clear or node.content is not True))
    for line in lines:
        line.text = " ".join("".join(data for node, data in line.parts if not node.out).split())
        linked = sum(len(data.strip()) for node, data in line.parts if node.link and not node.out)
        line.ratio = max(0, len(line.text) - linked) / max(1, line.tags)
    commented = False
    for line in lines:
        node, above = line.node, line.node.parent
        if line.text and node.tag in HEADINGS and above.tag in ("section", "div") and not above.goes and above.content is not True and COMMENT_HEADING.fullmatch(line.text):
            above.goes = commented = True  # a part of the page under the heading "Comments"
    if commented:
        settle(lines, nodes, trusting, clear)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-np.arange(-RADIUS, RADIUS + 1) ** 2 / (2 * SIGMA**2))
    return np.convolve(np.pad(ratios, RADIUS), kernel / kernel.sum(), "valid")


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which values are in the upper of two clusters: cut where the variance inside both is least; all, if the two are not apart."""
    order = np.sort(values)
    if order[0] == order[-1]:
        return np.ones(len(values), bool)
    n = np.arange(1, len(order))
    low, low2 = np.cumsum(order)[:-1], np.cumsum(order**2)[:-1]
    high, high2 = order.sum() - low, (order**2).sum() - low2
    inside = low2 - low**2 / n + high2 - high**2 / (len(order) - n)
    inside[order[1:] == order[:-1]] = np.inf
    cut = int(np.argmin(inside))
    if high[cut] / (len(order) - n[cut]) < APART * low[cut] / n[cut]:
        return np.ones(len(values), bool)
    return values >= order[cut + 1]


def region(lines: list[Line], core: np.ndarray, nodes: list[Node]) -> list[Line]:
    """The lines of the content regions; nodes: all elements, parents first."""
    for node in nodes:
        node.outer = node.parent.outer if node.parent is not None else None  # the outermost article or main element around it
        if node.outer is None and node.main and not node.out:
            node.outer = node
        node.mass, node.branch = 0, None
    mains = [line.node.outer for line in lines]
    if any(m is not None for m in mains):
        chosen = {id(m) for m, c in zip(mains, core, strict=True) if m is not None and c} or {id(m) for m in mains if m is not None}
        return [line for line, m in zip(lines, mains, strict=True) if m is not None and id(m) in chosen]
    for line, c in zip(lines, core, strict=True):
        line.node.mass += len(line.text) * bool(c)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.mass += node.mass
    least = MOST * nodes[0].mass
    top = max((n for n in nodes if n.mass >= least), key=lambda n: n.depth)
    for node in nodes:
        if node is top:
            node.branch = top
        elif node.parent is not None and node.parent.branch is not None:  # below top: its child that leads here
            node.branch = node if node.parent is top else node.parent.branch
    at = [i for i, line in enumerate(lines) if line.node.branch is not None]
    cores = [i for i in at if core[i]]
    first, last = cores[0], cores[-1]
    while first > at[0] and lines[first - 1].node.tag in HEADINGS:
        first -= 1
    live = {id(lines[i].node.branch) for i in cores} - {id(top)}
    kept = []
    for i in at:
        line = lines[i]
        direct = line.node is top or line.node is line.node.branch and line.node.tag != "div"
        if core[i] or first <= i <= last and (line.node.tag in HEADINGS or id(line.node.branch) in live or direct and line.ratio > 0):
            kept.append(line)
    return kept


def main_blocks(html: str) -> list[str]:
    """The blocks of a page's main text, in order; none if it has none."""
    events = Events()
    every = events.read(html)
    for trusting in (True, False):  # a page that calls all of itself a menu is taken by its ratios
        settle(every, events.nodes, trusting, events.clear)
        if any(line.text for line in every):
            break
    if not any(line.text for line in every):
        return []
    core = upper_cluster(np.log1p(smoothed(np.array([line.ratio for line in every]))))
    there = [i for i, line in enumerate(every) if line.text]
    lines = [every[i] for i in there]
    core = core[there]
    return [line.text for line in region(lines, core if core.any() else np.ones(len(lines), bool), events.nodes)]


def main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages with text and n_chars (its code points), in place of columns of these names.

    White space inside a block is one space, blocks are joined by two line feeds in page order.
    A null or empty page, and one without text, has an empty text.  Pages are read whole; a page
    that ends inside a tag or a comment ends before it.  keep: the columns that come back."""

    def measure():
        def run(html: pa.Array) -> list[pa.Array]:
            texts = ["\n\n".join(main_blocks(page)) if page else "" for page in html.to_pylist()]
            return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

        return run

    return attach(pages, html_col, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], measure, keep=keep)
