"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams a page's events; a page becomes lines,
one for each run of text between block tags, with the number of its text
characters and of the tags met since the line before. The ratio of the two is
smoothed with a Gaussian along the page and lines above a threshold are the
content lines. They are clustered by the sectioning element they stand in: the
innermost element that holds them all, or the article or main element around
it, is the content region; all its lines belong to the main text, short ones
too. Lines inside menus, headers, footers, sidebars, notices, adverts, forms
and reader comments are boilerplate, wherever they stand, and are never
content. A class, id or role that names one of those is no sign of it on an
element beside which the page has little else to say.

Defined results: a null or empty page, or one without content, has the empty
text. Unclosed and stray tags end with the elements around them; a new
paragraph ends an open one. Ties between regions go to the one that comes
first. Pages are read whole, in time that grows with their length, and repeated
pages alike. Character references are decoded once. White space inside a block, a line break tag included,
becomes one space; blocks are joined by a blank line. Other columns are not
read; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalmill.llm.batches import bound_batches

# Element names of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "script style noscript template head title svg math canvas iframe object audio video select option datalist map".split()
)
BOILERPLATE = frozenset("nav header footer aside form button dialog menu label fieldset textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
REGIONS = frozenset("body article main section div td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in a class, id or role that name boilerplate.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion "
    "promoted cookie cookies consent gdpr notice notices alert alerts notification popup modal overlay nav navbar navigation navigator menu menus "
    "menubar breadcrumb breadcrumbs sidebar sidebars aside complementary contentinfo footer footers masthead topbar "
    "toolbar header search comment comments commentlist disqus respond reply replies discussion reviews share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login widget widgets pagination pager "
    "skip hidden copyright".split()
)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Before a mark, words that speak of another element than the one they stand on.
ELSEWHERE = frozenset("has no with without".split())
#: A marked element is boilerplate only if the rest of the page has this share of its text at least.
REST = 0.25
#: Of a menu, the share of the text that is links at least.
LINKS = 0.8
#: Of the mean ratio of a page, what the ratios of a menu's lines don't reach.
THIN = 0.25
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Closed by the opening of the same (or of a sibling of their) kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
         "th": {"td", "th"}, "option": {"option"}}
_SHUTS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
          "th": {"table", "tr"}, "option": {"select"}}


@dataclass
class Line:
    text: str
    tags: int
    region: int
    boilerplate: bool
    #: The innermost element around it that a name marks, 0 for none.
    mark: int = 0
    #: Characters of links.
    linked: int = 0


@dataclass
class Element:
    """An open element, and what holds for the text in it."""

    name: str
    unseen: bool = False
    boilerplate: bool = False
    region: int = 0
    mark: int = 0
    #: Inside an article or main element.
    landmark: bool = False
    link: bool = False
    #: The element around the headers that it stands in.
    outside: Element | None = None


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether attributes hide an element."""
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and _HIDDEN.search(value):
            return True
    return False


def _named(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a class, id or role marks an element as boilerplate."""
    for name, value in attributes:
        for word in value.split() if value and name in ("class", "id", "role") else ():
            parts = [p.lower() for p in _PART.findall(word)]
            if any(p in MARKS and ELSEWHERE.isdisjoint(parts[:at]) for at, p in enumerate(parts)):
                return True
    return False


class PageLines(HTMLParser):
    """Collects the lines of a page from the parser's events; each event takes the same time however deep it stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Element] = [Element("")]
        #: Where the open elements of each name stand; under "block" those of all block elements.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        #: Of each region and each marked element, the one around it.
        self.parents, self.mark_parents = [0], [0]
        #: The regions that are article or main elements.
        self.landmarks: set[int] = set()
        self.pieces: list[str] = []
        self.linked = 0
        self.tags = 0

    def end_line(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces.clear()
            if text:
                at = self.open[-1]
                self.lines.append(Line(text, self.tags, at.region, at.boilerplate, at.mark, self.linked))
                self.tags = 0
            self.linked = 0

    def _last(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places[n]), default=0)

    def _leave(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        if self._last(["block"]) >= depth:
            self.end_line()
        for element in reversed(self.open[depth:]):
            self.places[element.name].pop()
            if element.name in BLOCKS:
                self.places["block"].pop()
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if (at := self._last(["p"])) and at == self._last(["block"]):
                self._leave(at)
        if tag in _ENDS and (at := self._last(_ENDS[tag])) > self._last(_SHUTS[tag]):
            self._leave(at)
        if tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        around = self.open[-1]
        free = tag in ("html", "body", "article", "main")
        hidden, named = not free and _hidden(attrs), not free and _named(attrs)
        if tag in HEADINGS and around.name == "header" and around.landmark and not (named or hidden):
            # The heading of an article in its own header is part of it.
            around = around.outside
        made = replace(around, name=tag, landmark=around.landmark or tag in ("article", "main"), link=around.link or tag == "a")
        made.outside = around.outside if around.name == "header" else around
        made.unseen |= tag in UNSEEN
        made.boilerplate |= tag in BOILERPLATE or hidden
        if tag in REGIONS:
            self.parents.append(made.region)
            made.region = len(self.parents) - 1
            if tag in ("article", "main"):
                self.landmarks.add(made.region)
        if named:
            self.mark_parents.append(made.mark)
            made.mark = len(self.mark_parents) - 1
        self.places[tag].append(len(self.open))
        if tag in BLOCKS:
            self.places["block"].append(len(self.open))
        self.open.append(made)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if at := self._last([tag]):
            self._leave(at)
        elif tag in BLOCKS:
            self.end_line()

    def handle_data(self, data: str) -> None:
        if not self.open[-1].unseen:
            self.pieces.append(data)
            self.linked += len(data.strip()) if self.open[-1].link else 0


def settle_marks(lines: list[Line], parents: list[int]) -> None:
    """Make lines inside marked elements boilerplate, save for the marks of elements that hold nearly all there is.

    ``parents`` has the marked element around each, numbered as they open; 0 is none.
    """
    own, held = [0] * len(parents), [0] * len(parents)
    for x in lines:
        own[x.mark] += 0 if x.boilerplate else len(x.text)
    for mark in range(len(parents) - 1, 0, -1):
        held[mark] += own[mark]
        held[parents[mark]] += held[mark]
    # The outer before the inner. ``live`` is the text under no mark that counts; what is under marks not yet settled isn't in it.
    live, void, clear = own[0], [True] * len(parents), [True] * len(parents)
    for mark in range(1, len(parents)):
        void[mark] = live < REST * held[mark]
        clear[mark] = clear[parents[mark]] and void[mark]
        live += own[mark] if clear[mark] else 0
    for x in lines:
        x.boilerplate |= not clear[x.mark]


#: A marked section of no known name, at which the parser would give up, and what begins a tag or a comment.
_ODD_SECTION = re.compile(r"<!\[(?!(?:cdata|temp|ignore|include|rcdata|if|else|endif)(?![-_.a-z0-9]))", re.IGNORECASE)
_OPENING = re.compile(r"<[a-zA-Z/!?]")


def readable(html: str) -> str:
    """A page as the parser can read it: odd marked sections are text, and a tag or comment that the page ends in is cut.

    Nothing after the last ``>`` can be a whole tag; looking for its end again
    from each ``<`` would take time that grows with the square of the page.
    """
    cut = _OPENING.search(html, html.rfind(">") + 1)
    return _ODD_SECTION.sub("&lt;![", html[: cut.start()] if cut else html)


def page_lines(html: str) -> tuple[list[Line], list[int], set[int]]:
    """The lines of a page, the region around each region, and the regions that are article or main elements."""
    parser = PageLines()
    parser.feed(readable(html))
    parser.close()
    parser.end_line()
    settle_marks(parser.lines, parser.mark_parents)
    return parser.lines, parser.parents, parser.landmarks


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along a page; the weights outside it go to the lines inside."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def content_lines(
    lines: list[Line], parents: list[int], landmarks: set[int], sigma: float = 1.0, spread: float = 0.5
) -> list[Line]:
    """The lines of the content region.

    A line's ratio is its characters for each tag; lines whose smoothed ratio
    reaches ``spread`` standard deviations (or the mean, where that is less) are
    content. An element of the page counts what its own lines and the elements
    inside it hold; the innermost one that still holds all content, or the
    outermost article or main element around it, is the region.
    """
    if not lines:
        return []
    ratio = np.array([0.0 if x.boilerplate else len(x.text) / max(1, x.tags) for x in lines])
    smooth = smoothed(ratio, sigma)
    bar = min(spread * ratio.std(), ratio.mean())
    chosen = [not x.boilerplate and s >= bar and s > 0 for x, s in zip(lines, smooth.tolist(), strict=True)]
    held = np.zeros(len(parents))
    for x, content in zip(lines, chosen, strict=True):
        held[x.region] += len(x.text) if content else 0
    for region in range(len(parents) - 1, 0, -1):
        held[parents[region]] += held[region]
    if not held[0]:
        return []
    best = 0
    for region in range(1, len(parents)):
        if parents[region] == best and held[region] == held[0]:
            best = region
    around = best
    while around:
        best = around if around in landmarks else best
        around = parents[around]
    within, landmark = [False] * len(parents), [False] * len(parents)
    within[best] = True
    text, linked, dense = [0] * len(parents), [0] * len(parents), [0] * len(parents)
    for x, own in zip(lines, ratio.tolist(), strict=True):
        text[x.region] += len(x.text)
        linked[x.region] += x.linked
        dense[x.region] += len(x.text) if own >= THIN * ratio.mean() else 0
    for region in range(1, len(parents)):
        within[region] = within[region] or within[parents[region]]
        landmark[region] = region in landmarks or landmark[parents[region]]
    # Elements of little but links are menus, whatever their names, if their lines are thin.
    menu = [not landmark[r] and 2 * dense[r] < text[r] <= linked[r] / LINKS for r in range(len(parents))]
    return [x for x in lines if within[x.region] and not x.boilerplate and not menu[x.region]]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    return "\n\n".join(x.text for x in content_lines(*page_lines(html)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bound_batches(pages.sparkSession)
    schema = "page_id long, url string, text string, n_chars long"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            columns = [
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())
            ]
            yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(each, schema)
