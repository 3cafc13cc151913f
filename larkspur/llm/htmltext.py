"""Main-text extraction: standard-library parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The parser's events are folded as they come into lines, one for each block of text, with the tags met since the line
before. Elements that never hold the article (menus, page headers and footers, sidebars, forms, scripts, styles) are skipped
by tag. Elements that a class, id or role names as menu, notice, advert, sidebar or reader comments are marked: one whole
name must say so, with no words in it but such and neutral ones (`ad-box`, `leftSidebar`; not `search-history`). Each line's
ratio of characters to tags is smoothed with a Gaussian kernel; lines at or above the threshold (the mean less half the
deviation, six tenths of the mean at most) form the content clusters. They decide three things: a marked element that holds
more than half of the clustered text is no sidebar, and its mark is void; the region is the deepest container that holds
all clustered text, an article or main element ending the descent (of several articles, the one with most clustered text);
and runs of lines that are mostly links are dropped from it if they reach outside the clusters. Every other line of the region
stays.

Character references are decoded; white space in a block becomes one space; blocks are joined by one newline. Time and memory
are in proportion to the page, however deep or broken its nesting.

Edge cases: null, empty and blank pages, and pages without text, give an empty text and 0 characters; unclosed and misnested
tags are closed where the next block or the end forces it; repeated rows give equal results. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: Elements that hold no article text. A header inside article or main is no page header and stays.
SKIPPED = frozenset("nav header footer aside form script style noscript template svg iframe button select textarea head dialog menu canvas object audio video map datalist".split())
#: Words of a class, id or role that mark such elements.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "disqus replies reply widget toolbar pagination pager complementary contentinfo search".split()
)
#: Words that may stand beside them in a name.
NEUTRAL = frozenset(
    "a an the of for to in on and by left right top bottom upper lower side inner outer first last main primary secondary global local sticky fixed site page post article blog user reader readers "
    "box boxes bar block blocks container wrapper wrap holder panel pane area zone region slot unit section list lists item items link links button buttons icon icons form thread stories posts articles content "
    "header head title body text image img large small big mini mobile desktop policy message messages sign up log email mail js ui el id widget module component row col column group".split()
)
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption option title".split())
CONTAINERS = frozenset("html body article main section div td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a block closes within which elements: its like within their list or table.
LIKE = {"li": (("li",), ("ul", "ol")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
_WORDS = re.compile(r"[A-Za-z]+")
_SPLIT = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marked(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(_SPLIT.sub("-", token))]
                if any(w in MARKS for w in words) and all(w in MARKS or w in NEUTRAL for w in words):
                    return True
    return False


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name in ("hidden", "aria-hidden") and value != "false" for name, value in attrs)


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    region: int
    mark: int  # innermost marked element


class Open(NamedTuple):
    tag: str
    region: int
    mark: int
    skipped: bool


class Lines(HTMLParser):
    """Folds parser events into lines. Open elements are a stack; of each tag, and of blocks and containers, the places in it
    are kept, so that no event looks through the stack."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # also under "BLOCK" and "CONTAINER"
        self.skips = 0
        self.regions: list[tuple[str, int]] = [("", 0)]  # tag and parent of each container
        self.marks: list[int] = [0]  # parent of each marked element; 0 is none
        self.inside = 0  # open article and main elements
        self.links = 0
        self.text: list[str] = []
        self.linked = 0
        self.tags = 1
        self.lines: list[Line] = []

    def _last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=-1)

    def _end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                at = self.open[-1] if self.open else Open("", 0, 0, False)
                self.lines.append(Line(line, self.tags, self.linked, at.region, at.mark))
                self.tags = 1
            self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            if tag != "hr":
                self._imply(tag)
        elif tag == "br" and not self.skips:
            self.text.append(" ")
        if tag in VOID:
            return
        region, mark = (self.open[-1].region, self.open[-1].mark) if self.open else (0, 0)
        skipped = (tag in SKIPPED and not (tag == "header" and self.inside)) or (bool(attrs) and _hidden(attrs))
        if attrs and tag not in ("html", "body", "main") and not (tag == "article" and not self.inside) and _marked(attrs):
            self._end_line()
            self.marks.append(mark)
            mark = len(self.marks) - 1
        if tag in CONTAINERS:
            role_main = any(n == "role" and v == "main" for n, v in attrs)
            self.regions.append(("main" if role_main else tag, region))
            region = len(self.regions) - 1
            self.places["CONTAINER"].append(len(self.open))
        if tag in BLOCKS:
            self.places["BLOCK"].append(len(self.open))
        self.places[tag].append(len(self.open))
        self.open.append(Open(tag, region, mark, skipped))
        self.skips += skipped
        self.inside += tag in ("article", "main")
        self.links += tag == "a"

    def _imply(self, tag: str) -> None:
        """A block closes an open paragraph; li, dd, dt, td, th, tr and option close their like, within their list or table."""
        like, stop = LIKE.get(tag, ((), ()))
        while True:
            same, paragraph, end = self._last(*like), self._last("p"), self._last(*stop) if like else self._last("BLOCK")
            if paragraph > same and paragraph >= end:
                return self._close(paragraph)
            if same <= end:
                return None
            self._close(same)

    def _close(self, k: int) -> None:
        if self.open[k].mark != (self.open[k - 1].mark if k else 0):
            self._end_line()
        while len(self.open) > k:
            tag, _, _, skipped = self.open.pop()
            self.places[tag].pop()
            if tag in BLOCKS:
                self.places["BLOCK"].pop()
            if tag in CONTAINERS:
                self.places["CONTAINER"].pop()
            self.skips -= skipped
            self.inside -= tag in ("article", "main")
            self.links -= tag == "a"

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        k = self._last(tag)
        # an inline end tag doesn't reach outside its block, nor a paragraph's outside its container
        if k >= 0 and not (tag not in BLOCKS and self._last("BLOCK") > k) and not (tag == "p" and self._last("CONTAINER") > k):
            self._close(k)

    def handle_data(self, data: str) -> None:
        if not self.skips:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the kernel is cut and its rest weighs 1 again."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    take = slice(r, r + len(x))
    return np.convolve(x, kernel)[take] / np.convolve(np.ones(len(x)), kernel)[take]


def clusters(lines: list[Line]) -> np.ndarray:
    ratio = smooth(np.array([len(x.text) / x.tags for x in lines]))
    return ratio >= min(ratio.mean() - 0.5 * ratio.std(), 0.6 * ratio.mean())


def summed(own: list[int], parents: list[int]) -> list[int]:
    """Sums over subtrees; a parent comes before its children."""
    for k in range(len(own) - 1, 0, -1):
        own[parents[k]] += own[k]
    return own


def unmarked(lines: list[Line], parents: list[int]) -> list[Line]:
    """Lines outside marked elements, but for those that hold more than half of the clustered text."""
    if len(parents) == 1 or not lines:
        return lines
    own = [0] * len(parents)
    for x, c in zip(lines, clusters(lines), strict=True):
        own[x.mark] += len(x.text) * bool(c)
    weight = summed(own, parents)
    gone = [False] * len(parents)
    for k in range(1, len(parents)):
        gone[k] = gone[parents[k]] or 2 * weight[k] <= weight[0]
    return [x for x in lines if not gone[x.mark]]


def link_runs(lines: list[Line], chosen: np.ndarray) -> list[bool]:
    """Which lines belong to a run of lines that are mostly links, of which one at least is outside the clusters."""
    out, at = [False] * len(lines), 0
    while at < len(lines):
        end = at
        while end < len(lines) and 2 * lines[end].linked >= len(lines[end].text):
            end += 1
        out[at:end] = [not chosen[at:end].all()] * (end - at)
        at = end + 1
    return out


def extract(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = unmarked(parser.finish(), parser.marks)
    if not lines:
        return ""
    chosen = clusters(lines)
    tags, parents = [t for t, _ in parser.regions], [p for _, p in parser.regions]
    own = [0] * len(parents)
    for x, c in zip(lines, chosen, strict=True):
        own[x.region] += len(x.text) * bool(c)
    weight = summed(own, parents)
    heads = [k for k in range(len(tags)) if weight[k] and tags[k] in ("article", "main")]
    region = 0
    if heads:
        region = max(heads, key=lambda k: (tags[k] == "article", weight[k], -k))
    else:
        for k in range(1, len(parents)):  # the one child with all the weight, again and again
            if parents[k] == region and weight[k] == weight[region]:
                region = k
    inside = [k == region for k in range(len(parents))]
    for k in range(1, len(parents)):
        inside[k] = inside[k] or inside[parents[k]]
    return "\n".join(x.text for x, out in zip(lines, link_runs(lines, chosen), strict=True) if inside[x.region] and not out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch["_html"]]
        kept = [c for c in batch.schema.names if c != "_html"]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with text and n_chars (code points) of every row."""
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_html")
    return rows.mapInArrow(_extract, f"{fields}, text string, n_chars long")


def page_texts(pages: DataFrame) -> DataFrame:
    """The op7 digest."""
    return extract_pages(pages)
