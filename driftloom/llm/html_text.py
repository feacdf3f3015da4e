"""HTML extraction (operator 10).

Method: the standard library's parser streams its events; they are laid out as lines, one per
block of the page, each with its characters of text and its tags. Text-to-tag ratios are smoothed
by a Gaussian over neighbouring lines and split in two clusters by a threshold. The region is the
element whose content lines outweigh its other lines by the most text. Of a region that the page
marks, or whose lines are mostly content, all lines stay, of any other the content lines. This
decides every page.

What the page says of itself is a prior on a line's ratio: ``PRIOR`` times as much inside a marked
article that holds a good part of the text, and as much less outside of it or in an element whose
class, id or role has a word like "comments". Such words count for no element with an article or
over half of the page's text. Elements that are no text of the article by their tag (menus, footers,
sidebars, forms, scripts, styles) are left out before.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import table

#: Lines on each side that the Gaussian reaches, and its standard deviation in lines.
REACH, SIGMA = 2, 1.0
#: Rounds of the two-cluster threshold.
ROUNDS = 20
#: Factor between the means of two clusters that are not one.
APART = 2.0
#: How many times the text of a marked article an element of aside words must hold to count as content.
FAR_MORE = 10
#: Share of a page's text from which a marked article is a prior, and the prior's factor.
ENOUGH, PRIOR = 0.4, 4.0

# Names of elements by what they do to the text.
HIDDEN = frozenset("script style noscript template head title textarea select option button iframe object embed canvas svg math audio video datalist dialog".split())
ASIDE = frozenset("nav footer aside form menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that can be a region.
REGIONS = frozenset("article main section div body center details table td blockquote figure search".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role values that speak against a line.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-links comment comments commentlist contentinfo cookie cookies "
    "consent disqus dialog footer gdpr menu menubar nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion "
    "related replies reply respond search share sharing sidebar sidebars skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
_MARK = re.compile(r"[A-Za-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def is_aside(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element holds something other than the article."""
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if value and name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def has_aside_words(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class, id or role says that an element holds something other than the article."""
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for part in value.split():
                if {x.lower() for x in _MARK.findall(_CAMEL.sub(" ", part))} & ASIDE_WORDS:
                    return True
    return False


@dataclass
class Line:
    """A block of text, the tags since the line before, and the innermost element around it."""

    text: str
    tags: int
    element: int
    in_article: bool


class _Lines(HTMLParser):
    """Lays a page out as lines, and keeps the tree of elements that could be regions or have words."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, left out, article, element around it
        self.names: Counter[str] = Counter()  # of open elements
        self.left_out = self.articles = 0
        self.parent, self.marked, self.worded, self.region = [-1], [False], [False], [True]
        self.at = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip(" ")
        if text:
            self.found.append(Line(text, self.tags, self.at, self.articles > 0))
            self.tags = 0
        self.parts.clear()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        if tag == "p" and any(t == "p" for t, _, _, _ in self.open[-3:]):
            self._close("p")
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self._close("li")
        if tag not in IN_HEAD and self.names["head"]:
            self._close("head")  # its end tag may be omitted
        article = tag in ("article", "main")
        out = tag in HIDDEN and not (tag == "math" and self.articles) or is_aside(tag, attrs, self.articles > 0)
        worded = not out and has_aside_words(tag, attrs)
        if worded:
            self.flush()
        self.open.append((tag, out, article, self.at))
        self.names[tag] += 1
        if worded or tag in REGIONS:
            self.parent.append(self.at)
            self.marked.append(article and not self.left_out)
            self.worded.append(worded)
            self.region.append(tag in REGIONS)
            self.at = len(self.parent) - 1
        self.left_out += out
        self.articles += article

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID:  # HTML takes no notice of the slash
            self.handle_starttag(tag, attrs)

    def _close(self, tag: str) -> None:
        if not self.names[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if self.at != self.open[k][3]:
                    self.flush()
                for name, out, article, _ in self.open[k:]:
                    self.left_out -= out
                    self.articles -= article
                    self.names[name] -= 1
                self.at = self.open[k][3]
                del self.open[k:]
                return
            # An inner end tag does not close the region around it.
            if self.open[k][2] or self.open[k][1] and tag not in ("html", "body", "article", "main"):
                if tag not in BLOCKS:
                    return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        if not self.left_out:
            self.parts.append(data)

    def unknown_decl(self, data):
        """CDATA sections are left out, as browsers do in HTML."""

    def up(self, own: np.ndarray) -> np.ndarray:
        """For each element, the sum of ``own`` over it and all below it."""
        total = own.tolist()
        for k in range(len(total) - 1, 0, -1):
            total[self.parent[k]] += total[k]
        return np.array(total)

    def against(self, size: np.ndarray, in_article: np.ndarray) -> np.ndarray:
        """Elements inside one whose words speak against it: never one with an article or most of the text."""
        own = np.zeros(len(self.parent))
        np.add.at(own, [x.element for x in self.found], size)
        most = max(size.sum() / 2, FAR_MORE * size[in_article].sum())
        bad = np.array(self.worded) & (self.up(np.array(self.marked, float)) == 0) & (self.up(own) <= most)
        for k in range(1, len(bad)):
            bad[k] |= bad[self.parent[k]]
        return bad


def page_lines(html: str) -> _Lines:
    """The lines of a page, in page order, with their elements."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios under a Gaussian over neighbouring lines; at the ends over those that are there."""
    n = len(ratios)
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    return np.convolve(ratios, kernel)[REACH : REACH + n] / np.convolve(np.ones(n), kernel)[REACH : REACH + n]


def cluster_threshold(smooth: np.ndarray) -> float:
    """Threshold between two clusters of smoothed ratios.

    It moves to the middle of the cluster means until it rests. Lines that are all alike, or whose
    cluster means are within ``APART``, are one cluster: its threshold is below all of them.
    """
    one = min(float(smooth.min()) * (1 - 1e-9), float(smooth.mean()) / APART)
    if np.ptp(smooth) <= 1e-9 * max(1.0, smooth.max()):
        return one
    at = smooth.mean()
    for _ in range(ROUNDS):
        high = smooth > at
        if high.all() or not high.any():
            return one
        moved = (smooth[high].mean() + smooth[~high].mean()) / 2
        if abs(moved - at) < 1e-9:
            break
        at = moved
    high = smooth > at
    if not high.any() or high.all() or smooth[high].mean() < APART * smooth[~high].mean():
        return one
    return float(at)


def content_lines(ratios: np.ndarray, prior: np.ndarray | float = 1.0) -> np.ndarray:
    """Which lines are content: their smoothed ratio times their prior is over the threshold.

    A line at the border of the content, which smoothing lowers, is content if its own ratio times
    its prior is over half the threshold.
    """
    smooth = smoothed(ratios)
    at = cluster_threshold(smooth)
    return (smooth * prior > at) | (ratios * prior > at / 2) & (np.asarray(prior) >= 1)


def region_lines(page: _Lines) -> np.ndarray:
    """Which lines of a page are its main text."""
    size = np.array([len(x.text) for x in page.found])
    marked = np.array([x.in_article for x in page.found])
    element = np.array([x.element for x in page.found])
    against = page.against(size, marked)[element]
    prior = np.ones(len(size))
    if size[marked].sum() >= ENOUGH * size.sum():
        prior = np.where(marked, PRIOR, 1 / PRIOR)
    prior[against] = 1 / PRIOR**2
    content = content_lines(size / np.array([max(1, x.tags) for x in page.found]), prior)
    # The region: the element, of equal ones the innermost, whose content outweighs the rest by the
    # most. What words and clusters agree to cut weighs nothing.
    own = np.zeros(len(page.parent))
    np.add.at(own, element, np.where(content, size, np.where(against, 0, -size)))
    weight = np.where(page.region, page.up(own), -np.inf)
    best = len(weight) - 1 - int(weight[::-1].argmax())
    inside = np.zeros(len(weight), bool)
    inside[best] = True
    for k in range(best + 1, len(weight)):
        inside[k] |= inside[page.parent[k]]
    chosen = inside[element]
    whole = page.marked[best] and prior.max() > 1
    if whole or 2 * (content & chosen).sum() >= (chosen & ~against).sum():
        return chosen & (content | ~against)
    return chosen & content


def main_text(html: str) -> str:
    """Main text of a page: blocks in page order, joined by an empty line; empty if there is none."""
    page = page_lines(html)
    if not page.found:
        return ""
    return "\n\n".join(x.text for x, keep in zip(page.found, region_lines(page)) if keep)


def main_text_column(html: Column) -> Column:
    """Main text of each whole page; null counts as empty."""

    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py() or "") for p in pages], pa.string())

    return F.arrow_udf(extract, "string")(html)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add the main text and its ``n_chars`` (code points).

    A page that is null, empty or without text outside menus and the like gets an empty text.
    Pages are read one by one, so repeated rows need no rule. Columns with these names are replaced.
    """
    return pages.withColumn(text_col, main_text_column(F.col(html_col))).withColumn("n_chars", F.length(text_col).cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all of ``pages``."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op10_html_text": op10_html_text}
ORACLES: dict[str, str] = {}
