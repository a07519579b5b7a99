"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The standard library's streaming parser cuts a page into blocks (the lines of this method). Blocks inside
menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments are marked by their
elements and class names. A class or id marks by its head word ("site-footer", "comments-area"; not "ad-free" or
"no-sidebar"), and never the page, its body, main or an article. Where HTML leaves an end tag out, the next start
tag implies it. Each block's ratio of characters to tags is smoothed along the page; the blocks over
the threshold form the content clusters, and these choose what is kept (:func:`selected`): the article and main
elements that hold a cluster, with every unmarked block in them, however short; on other pages the stretch from
the first to the last cluster and the running text at its ends. An article is a strong hint and no more: where the
clusters outside hold three times the text inside, they are the content. Other blocks of an article's own header than
its headings are kept if their ratios make them part of a cluster: a lead paragraph is, a byline is not.
Reading and choosing take time in proportion to the page, whatever tags it leaves open.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchkeeper.llm.text import by_batch, column, prepare

# fixed values: elements of the HTML standard by what they mean here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table caption tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(("article", "main"))
MARKED = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea label input "
    "iframe svg math canvas object audio video dialog menu search fieldset".split()
)
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu sidebar footer masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe share sharing social related recommended recommendations comment comments disqus respond reply "
    "replies login signup pagination pager widget toolbar copyright disclaimer alert skip".split()
)
#: Marks outside articles only: an article's own header holds its heading.
MARKED_OUTSIDE = frozenset("header topbar logo".split())
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
#: Elements whose class and id tell of the page or the article, not of what to leave out.
UNNAMED = frozenset("html body main article".split())
#: Words behind a head word that only say how or where it is shown; and words that deny what follows.
SHAPES = frozenset(
    "area bar block box button buttons col column container content contents form group head icon icons inner item items left "
    "link links list main module outer panel placeholder post posts primary right row secondary section slot text title top "
    "bottom unit wrap wrapper".split()
)
DENIALS = frozenset("no not non has have had with without hide hidden disable disabled".split())

# where end tags may be left out: what a start tag closes, and the elements that it does not reach beyond
_CELLS, _LIST_STOPS = frozenset(("td", "th")), BLOCK - {"address", "div", "p"}
_ROWS = _CELLS | {"tr"}
_BODIES = _ROWS | {"caption", "colgroup", "thead", "tbody", "tfoot"}
_TABLE = frozenset(("table",))
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), _LIST_STOPS - {"li"}),
    **dict.fromkeys(("dd", "dt"), (frozenset(("dd", "dt")), _LIST_STOPS - {"dd", "dt"})),
    **dict.fromkeys(_CELLS, (_CELLS, _TABLE | {"tr"})),
    "tr": (_ROWS | {"caption", "colgroup"}, _TABLE | {"thead", "tbody", "tfoot"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (_BODIES, _TABLE)),
    "option": (frozenset(("option",)), frozenset(("select", "datalist", "optgroup"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
}
ENDS_P = BLOCK - {"body", "caption", "html", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
P_STOPS = frozenset("button caption html object table td template th".split())

SIGMA = 1.0
RADIUS = 3
#: Blocks over this share of the standard deviation of the smoothed ratios belong to a cluster.
THRESHOLD = 0.5
#: Clusters outside all articles are the content if they hold this many times the text inside.
OUTSIDE = 3


@dataclass
class Block:
    text: str
    tags: int
    marked: bool
    region: int
    heading: bool
    wrapped: bool  # in an article that lies in an element marked by its name
    doubtful: bool = False  # in an article's own header, and no heading
    links: bool = False  # more than half of its characters are links


def head_marks(name: str, names: frozenset[str]) -> bool:
    """Whether one class or id is a marking name, or has one as its head word."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    while len(parts) > 1 and parts[-1] in SHAPES and parts[-1] not in names:
        parts.pop()
    return bool(parts) and parts[-1] in names and not DENIALS.intersection(parts[:-1])


class Blocks(HTMLParser):
    """Collects the blocks of one page, with the outermost article or main element each lies in (0: none)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        # tag, marked, marked by a name, region, inside a region's header, region inside an element marked by a name
        self.open: list[tuple[str, bool, bool, int, bool, bool]] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # where each tag is open, outermost first
        self.regions = 0
        self.parts: list[str] = []
        self.tags = 1
        self.linked = 0
        self.heading = False

    def _state(self) -> tuple[bool, bool, int, bool, bool]:
        return self.open[-1][1:] if self.open else (False, False, 0, False, False)

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            marked, named, region, in_header, wrapped = self._state()
            links = 2 * self.linked > len(text) - text.count(" ")
            doubtful = in_header and not self.heading
            self.blocks.append(Block(text, self.tags, marked or named, region, self.heading, wrapped, doubtful, links))
        self.parts, self.tags, self.linked, self.heading = [], 1, 0, False

    def _close_from(self, i: int) -> None:
        for x in self.open[i:]:
            self.at[x[0]].pop()
        del self.open[i:]

    def _imply_ends(self, closed: frozenset[str], stops: frozenset[str]) -> None:
        """Closes the outermost of the elements ``closed`` that no other element in ``stops`` lies in."""
        places = [self.at[t] for t in closed if self.at[t]]
        if not places:
            return
        stop = max((self.at[t][-1] for t in stops - closed if self.at[t]), default=-1)
        first = min((p[bisect_right(p, stop)] for p in places if p[-1] > stop), default=-1)
        if first >= 0:
            self._close_from(first)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK or tag in MARKED:
            self._end_block()
        if tag in ENDS_P:
            self._imply_ends(frozenset(("p",)), P_STOPS)
        if tag in IMPLIED:
            self._imply_ends(*IMPLIED[tag])
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        marked, named, region, in_header, wrapped = self._state()
        if tag in REGIONS and not region:
            self.regions += 1
            region = self.regions
            # main is never part of what a name marks; an article may be, such as a comment or a teaser
            named, wrapped = False, named and tag != "main"
        marked = marked or tag in MARKED or self._marks(attrs)
        if tag not in UNNAMED:
            named = named or self._named(attrs, MARKED_NAMES if region else MARKED_NAMES | MARKED_OUTSIDE)
        if tag == "header":
            # a page's header is no content; of an article's own header, the headings are
            marked, in_header = marked or not region, bool(region)
        self.heading = self.heading or tag in HEADINGS
        self.at[tag].append(len(self.open))
        self.open.append((tag, marked, named, region, in_header, wrapped))

    @staticmethod
    def _marks(attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if name == "role" and value and value.strip().lower() in MARKED_ROLES:
                return True
        return False

    @staticmethod
    def _named(attrs: list[tuple[str, str | None]], names: frozenset[str]) -> bool:
        return any(name in ("class", "id") and value and any(head_marks(x, names) for x in value.split()) for name, value in attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # HTML knows no self-closing elements: <div/> opens a div
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in MARKED:
            self._end_block()
        self.tags += 1
        if self.at[tag]:
            self._close_from(self.at[tag][-1])

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.at["a"]:
            self.linked += sum(map(len, data.split()))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown section is skipped like a comment
            end = self.rawdata.find(">", i)
            return len(self.rawdata) if end < 0 else end + 1

    def close(self) -> None:
        super().close()
        self._end_block()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian smoothing along the page; at its ends the kernel is cut and weighted anew. None at a sigma of 0."""
    if sigma == 0:
        return ratios
    kernel = np.array([math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)])
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def selected(blocks: list[Block], sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which blocks are content, by the clusters of smoothed ratios; marks and regions say what may be."""
    marked = np.array([b.marked for b in blocks])
    wrapped = np.array([b.wrapped for b in blocks])
    if not (marked | wrapped).all():  # else the marked element holds all the page has
        marked |= wrapped
    sizes = np.array([len(b.text) for b in blocks])
    ratios = np.where(marked, 0.0, sizes / np.array([b.tags for b in blocks]))
    level = smoothed(ratios, sigma)
    limit = threshold * level.std()
    cluster = ~marked & (level >= limit)
    doubtful = np.array([b.doubtful for b in blocks])
    links = np.array([b.links for b in blocks])
    # beside a long paragraph any line is in a cluster; a doubtful one must have the ratio itself
    cluster &= ~doubtful | (ratios >= limit)
    open_ = ~marked & (~doubtful | cluster)
    region = np.array([b.region for b in blocks])
    inside = open_ & (region > 0)
    outside = cluster & (region == 0)
    if inside.any() and sizes[outside].sum() <= OUTSIDE * sizes[inside].sum():
        chosen = set(region[cluster & inside & ~links].tolist())
        if not chosen:
            held = np.bincount(region[inside], weights=sizes[inside])
            chosen = {int(held.argmax())}
        return inside & np.isin(region, list(chosen))
    if not cluster.any():
        return open_
    at = np.flatnonzero(cluster)
    first, last = int(at[0]), int(at[-1])
    # running text and headings next to a cluster belong to it; marked blocks and lists of links end it
    ends = marked | links
    while first < last and ends[first]:
        first += 1
    while first < last and ends[last]:
        last -= 1
    while first and not ends[first - 1]:
        first -= 1
    while last + 1 < len(blocks) and not ends[last + 1]:
        last += 1
    open_[:first] = False
    open_[last + 1 :] = False
    return open_


def main_text(html: str | None) -> str:
    """The kept blocks of one page, joined by line ends; empty if there are none."""
    if not html:
        return ""
    reader = Blocks()
    reader.feed(html)
    reader.close()
    blocks = reader.blocks
    return "\n".join(b.text for b, k in zip(blocks, selected(blocks), strict=True) if k) if blocks else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` (code points) for each row of ``pages``.

    White space inside a block is one space, blocks are joined by one line end. Null and empty pages, and pages
    without content, have an empty text. Very long pages are read whole, in time that grows with their length. Rows that
    share an id are pages of their own. Other columns are ignored, whatever they are called; an empty table gives none.
    """
    prepare(pages.sparkSession)
    source = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )

    def rows(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h) for h in column(batch, "html").to_pylist()]
        return {
            "page_id": column(batch, "page_id"), "url": column(batch, "url"), "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }

    return by_batch(source, "page_id long, url string, text string, n_chars long", rows)
