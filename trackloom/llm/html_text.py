"""The main text of web pages.

The standard library's parser streams events into lines (blocks).  Each line has a ratio of its text outside links
to its tags.  The ratios are smoothed along the page with a Gaussian, and a threshold on the smoothed ratios splits
lines into content and the rest; runs of content lines are clusters.  The mass of the clusters in it chooses a region among
all containers: the articles, if they hold a third of it, else the main element, if that does, else the innermost container of
most of it.  What the clusters say of a line decides in three more places: text of a main element beside its articles comes
along if it is content or heads it; loose text (neither a paragraph, a heading, nor a part of a list, table or figure)
stays if its run has a content line; and an element with a doubtful name goes if it has none, or is mostly links.

What the contract names as no part of an article is left out of a region: menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments.  Elements and landmark roles say so, and a class or id does if all of
its words are of parts and places (``site-footer``, ``reader-comments``); if only some are (``no-sidebar``), it is in doubt.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text no reader sees, or that are controls.
HIDDEN = frozenset("audio button canvas datalist dialog form head iframe menu noembed noframes noscript object optgroup option script select style svg template textarea title video".split())
#: Elements and roles that are no part of an article.
APART = frozenset("nav aside footer".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
CONTAINERS = frozenset("article main section div td th body".split())
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: An open element of the left kinds ends where one of the right kinds begins.
ENDED_BY = {
    "p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]), "head": frozenset(["body", "head"]),
}
#: An element that is ended so is looked for no further up than these.
STOPS = frozenset("ul ol dl table div article section main body blockquote nav aside footer header form".split())
#: Words of class and id names: a name is that of a part if it has a word of parts and all others are of places.
PLACES = frozenset(
    """area articles bar block body bottom box buttons container content danger element feed form global group icons info inline inner item items latest left links list main module more newest outer page panel popular posts primary reader
    readers right row secondary section site slot stories success text thread top unit user users warning wrap wrapper""".split()
)
COMMENTS = frozenset("comment commentlist comments disqus replies respond responses".split())
PARTS = COMMENTS | frozenset(
    """ad ads advert advertisement advertising adverts adsense adslot alert alerts breadcrumb breadcrumbs consent cookie cookies gdpr menu menubar modal nav navbar navigation newsletter notice notices notification notifications outbrain
    paywall popover popup promo promos promoted promotion recommended related share sharing sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola toast toolbar trackback widget widgets""".split()
)
#: Words that, alone, may be the name of a passage as well.
EITHER = frozenset("recommended related share sharing social widget widgets".split())
#: Words that are of parts outside of articles, and of places inside, where a title may be in a header.
FRAME = frozenset("banner footer header masthead search topbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks whose text may be of any kind; all others have a purpose in an article.
LOOSE = frozenset(["", "address", "article", "body", "center", "details", "dialog", "dir", "div", "header", "html", "main", "section", "summary"])
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")

SIGMA, PIECE = 1.0, 1 << 16


def _names(attrs: list, article: bool) -> tuple[bool, bool]:
    """Whether a whole class or id is the name of a part, and whether one has a word of parts."""
    parts, places = (PARTS, PLACES | FRAME) if article else (PARTS | FRAME, PLACES)
    doubt = False
    for name, value in attrs:
        for one in (value or "").split() if name in ("class", "id") else ():
            words = {w.lower() for w in _WORDS.findall(one)}
            if words & parts:
                if words <= parts | places and not (article and words <= EITHER):
                    return True, True
                doubt = True
    return False, doubt


def _told(attrs: list) -> bool:
    """Whether an attribute hides an element or gives it the role of another part of the page."""
    for name, value in attrs:
        if name == "hidden" or name == "role" and (value or "").strip().lower() in ROLES or name == "style" and value and re.search(r"display\s*:\s*none", value):
            return True
    return False


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    tags: int
    apart: bool
    node: int
    doubt: int  # number of an element whose name may mean a part, or 0
    block: str  # the innermost block around it


class _Open(NamedTuple):
    name: str
    apart: bool
    node: int
    doubt: int
    block: str


_NONE = _Open("", False, 0, 0, "")


class _Lines(HTMLParser):
    """Lines of a page, and the tree of its containers: (parent, article around it, main around it), 0 for none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.nodes: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.open: list[_Open] = []
        self.places: dict[str, list[int]] = {}  # where elements of a name are open
        self.marks: list[int] = []  # where elements are open that another may end, or that stop the search for them
        self.stops: list[int] = []
        self.state = _NONE
        self.doubts = [0]  # of each element in doubt, the one around it
        self.text: list[str] = []
        self.plain = self.tags = self.links = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, self.plain, self.tags, self.state.apart, self.state.node, self.state.doubt, self.state.block))
            self.plain = self.tags = 0
        self.text = []

    def _push(self, one: _Open) -> None:
        at = len(self.open)
        self.open.append(one)
        self.places.setdefault(one.name, []).append(at)
        if one.name in STOPS:
            self.stops.append(at)
        if one.name in STOPS or one.name in ENDED_BY:
            self.marks.append(at)
        self.links += one.name == "a"
        self.state = one

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            name = self.open.pop().name
            self.places[name].pop()
            self.links -= name == "a"
        for places in (self.marks, self.stops):
            while places and places[-1] >= at:
                places.pop()
        self.state = self.open[-1] if self.open else _NONE

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        block = tag in BLOCKS
        if block or tag in HIDDEN:
            self.end_line()
        elif tag == "br" or tag in ("td", "th"):
            self.text.append(" ")
        # kinds that end each other don't pile up between two stops, so this looks at a few places only
        for at in reversed(self.marks):
            if tag in ENDED_BY.get(self.open[at].name, ()):
                self._close(at)
                break
            if self.open[at].name in STOPS:
                break
        if tag in VOID:
            return
        _, was, node, doubt, around = self.state
        _, article, main = self.nodes[node]
        apart = was or tag in HIDDEN or tag in APART or tag == "header" and not article and not main
        role = next(((v or "").strip().lower() for k, v in attrs if k == "role"), "")
        if attrs and not apart and tag not in ("html", "body"):
            region = tag in ("article", "main") or role in ("article", "main")
            told, may = _names(attrs, article > 0)
            apart = _told(attrs) or told and not region or tag == "article" and any({w.lower() for w in _WORDS.findall(v or "")} & COMMENTS and told for k, v in attrs if k in ("class", "id"))
            if may and block and not apart and not region:
                self.doubts.append(doubt)
                doubt = len(self.doubts) - 1
        if tag in CONTAINERS:
            self.nodes.append((node, article or (len(self.nodes) if tag == "article" or role == "article" else 0), main or (len(self.nodes) if tag == "main" or role == "main" else 0)))
            node = len(self.nodes) - 1
        if (apart, doubt) != (was, self.state.doubt) and not block and tag not in HIDDEN:
            self.end_line()
        self._push(_Open(tag, apart, node, doubt, tag if block else around))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and tag != "a":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS or tag in HIDDEN:
            self.end_line()
        found = self.places.get(tag)
        if found and (tag in BLOCKS or not self.stops or self.stops[-1] <= found[-1]):
            at = found[-1]
            outer = self.open[at - 1] if at else _NONE
            if (self.state.apart, self.state.doubt) != (outer.apart, outer.doubt):
                self.end_line()
            self._close(at)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if not self.links and not self.state.apart:
            self.plain += len(data)

    def close(self) -> None:
        """The end of the page: a tag or comment that isn't finished is none; other text that is held back is text.
        (The parser's own way to end takes a time that grows with the square of such a rest.)"""
        rest, self.rawdata = self.rawdata, ""
        if self.cdata_elem or not re.match("<[A-Za-z/!?]", rest):
            self.handle_data(rest if self.cdata_elem else unescape(rest))
        self.end_line()


def parsed(html: str) -> _Lines:
    """Lines and containers of a page.  Pieces grow, so that what the parser holds back is seldom read again."""
    parser = _Lines()
    at, size = 0, PIECE
    while at < len(html):
        parser.feed(html[at : at + size])
        at, size = at + size, 2 * size
    parser.close()
    return parser


def smoothed(x: list[float], sigma: float = SIGMA) -> list[float]:
    """A Gaussian mean along ``x``; the ends are averaged over what there is.  ``sigma`` 0 leaves it as it is."""
    if not sigma:
        return x
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(x)):
        lo, hi = max(0, i - reach), min(len(x), i + reach + 1)
        w = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(a * b for a, b in zip(x[lo:hi], w, strict=True)) / sum(w))
    return out


def content_lines(lines: list[Line], sigma: float = SIGMA) -> tuple[list[bool], float]:
    """Which lines are content by their smoothed ratios, and the threshold: the ratios' deviation, or mean if less."""
    ratios = smoothed([x.plain / max(1, x.tags) for x in lines], sigma)
    mean = sum(ratios) / len(ratios)
    spread = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    threshold = min(mean, spread) if spread else mean
    return [r >= threshold for r in ratios], threshold


def _innermost(nodes: list[tuple[int, int, int]], held: Counter) -> int:
    """The innermost container that holds at least two thirds of the content of each container around it."""
    total = Counter(held)
    children: dict[int, list[int]] = {}
    for node in range(len(nodes) - 1, 0, -1):  # a container's number is higher than its parent's
        total[nodes[node][0]] += total[node]
        children.setdefault(nodes[node][0], []).append(node)
    node = 0
    while children.get(node):
        best = max(children[node], key=lambda c: (total[c], -c))
        if not total[node] or 3 * total[best] < 2 * total[node]:
            break
        node = best
    return node


def _runs(marks: list) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    at = 0
    for end in range(1, len(marks) + 1):
        if end == len(marks) or marks[end] != marks[at]:
            yield at, end
            at = end


def _region(parser: _Lines, seeds: list[bool], threshold: float) -> list[bool]:
    """Which lines are in the region of most of the clusters' mass."""
    lines, nodes = parser.lines, parser.nodes
    article, main = [nodes[x.node][1] for x in lines], [nodes[x.node][2] for x in lines]
    mass = [x.plain if seed else 0 for x, seed in zip(lines, seeds, strict=True)]
    of_article: Counter = Counter()
    for a, n in zip(article, mass, strict=True):
        of_article[a] += n
    total, in_articles, in_main = sum(mass), sum(n for a, n in of_article.items() if a), sum(n for m, n in zip(main, mass, strict=True) if m)
    visible = [not x.apart for x in lines]
    if 3 * in_articles >= total and any(a and v for a, v in zip(article, visible, strict=True)):
        out = [a > 0 and (of_article[a] > 0 or not in_articles) for a in article]
        mains = {m for m, inside in zip(main, out, strict=True) if inside} - {0}
        follows = False
        for i in reversed(range(len(lines))):  # beside the articles: content, and what heads the line behind it
            if not out[i] and visible[i] and main[i] in mains and not article[i]:
                out[i] = seeds[i] and 2 * lines[i].plain >= len(lines[i].text) or follows and lines[i].block in HEADINGS or lines[i].block == "h1"
            follows = out[i] if visible[i] else follows
        return out
    if 3 * in_main >= total and any(m and v for m, v in zip(main, visible, strict=True)):
        return [m > 0 for m in main]
    held: Counter = Counter()
    for x, n in zip(lines, mass, strict=True):
        held[x.node] += n
    top = _innermost(nodes, held)
    inner = [False] * len(nodes)
    inner[top] = True
    for node in range(top + 1, len(nodes)):
        inner[node] = inner[nodes[node][0]]
    out = [inner[x.node] and (seed or 2 * x.plain >= len(x.text)) for x, seed in zip(lines, seeds, strict=True)]
    for at, end in _runs(seeds):  # clusters that reach into the region bring their dense lines along
        if seeds[at] and any(inner[lines[i].node] for i in range(at, end)):
            for i in range(at, end):
                out[i] = out[i] or lines[i].plain >= threshold * max(1, lines[i].tags)
    return out


def selected(parser: _Lines, sigma: float = SIGMA) -> list[bool]:
    """Which lines of a page are of its main text."""
    lines, nodes = parser.lines, parser.nodes
    content, threshold = content_lines(lines, sigma)
    seeds = [c and not x.apart for c, x in zip(content, lines, strict=True)]
    out = [inside and not x.apart for inside, x in zip(_region(parser, seeds, threshold), lines, strict=True)]
    plain, whole, dense = Counter(), Counter(), Counter()
    for x, seed in zip(lines, seeds, strict=True):
        plain[x.doubt] += x.plain
        whole[x.doubt] += len(x.text)
        dense[x.doubt] += seed
    for d in range(len(parser.doubts) - 1, 0, -1):  # an element's number is higher than that of the one around it
        for held in (plain, whole, dense):
            held[parser.doubts[d]] += held[d]
    gone: set[int] = set()
    for d in range(1, len(parser.doubts)):
        if parser.doubts[d] in gone or 2 * plain[d] < whole[d] or not dense[d]:
            gone.add(d)
    out = [inside and x.doubt not in gone for inside, x in zip(out, lines, strict=True)]
    # loose text in a row has one parent and is of one kind
    kinds = [(inside and x.block in LOOSE, nodes[x.node][0] if x.block != "article" else x.node) for inside, x in zip(out, lines, strict=True)]
    if any(inside and x.block not in LOOSE for inside, x in zip(out, lines, strict=True)):
        for at, end in _runs(kinds):
            if kinds[at][0] and not any(seeds[at:end]):
                out[at:end] = [False] * (end - at)
    return out


def main_text(html: str, sigma: float = SIGMA) -> str:
    """The article's blocks joined by an empty line, or an empty string."""
    parser = parsed(html)
    if not parser.lines:
        return ""
    return "\n\n".join(x.text for x, inside in zip(parser.lines, selected(parser, sigma), strict=True) if inside)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html, ...).

    A null html is empty, and has an empty text; n_chars counts code points.  Repeated rows give a row each.  Markup
    of any length and brokenness is read in time that grows with its length; a page without content gives an empty
    text.  Other columns are not looked at; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
