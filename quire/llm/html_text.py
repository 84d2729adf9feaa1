"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. A block element starts a new line; a line's ratio is its characters
outside links against its tags. Ratios are smoothed by a Gaussian along the page and cut in two clusters at the
threshold that parts them best (Otsu's, on logarithms). Lines belong to regions, their nearest sectioning element;
a region is content if most of its characters are in lines of the upper cluster and it is no list of links, and then
all its lines count, so short paragraphs stay. <article> and <main> are a prior alone: ratios aren't smoothed across
their edges, and where they hold half of a page's text or more, lines in them need no more than PROSE characters a tag,
wherever the threshold lies. Elements that are never article text (menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts, styles, hidden ones) give no lines at all. Names tell them by any
word, but not headings and inline elements in an article; ids of blocks and names of sections there, which often are
those of the text's own parts ("related-work"), must be made up of such words. Nested articles are part of the outermost.

Defined cases: a null or empty html gives an empty text; unclosed and stray tags are tolerated; any declaration that
isn't a comment ends at the next ">", and markup that never ends is dropped, as browsers do; a very long page takes
time in proportion to its length; repeated rows are extracted each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import collections
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
REGIONS = frozenset("article body div html main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED = frozenset("aside audio button canvas datalist dialog footer form head header iframe input label math menu nav noframes noscript object optgroup option script select style svg template textarea title video".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SKIPPED_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer discussion disqus "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related recommended "
    "reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser toolbar topbar widget".split()
)
#: Words that go along with those in a name, and words that head parts of an article as well.
FURNITURE = frozenset("area articles bar block box button buttons container content form inner items links list module outer panel posts section stories widgets wrap wrapper".split())
TOPICS = frozenset({"advertising", "disclaimer", "discussion", "navigation", "notice", "notices", "promotion"})
#: Open elements that the start of another ends, as HTML has it.
ENDED_BY = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option", "optgroup"}}
SIGMA = 1.5
#: Characters a tag that are enough for text in an article.
PROSE = 8


def _all_furniture(value: str) -> bool:
    """Whether a name in value is made of words for what is never article text alone."""
    names = ({*re.split(r"[^a-z]+", x)} - {""} for x in value.split())
    return any(words <= SKIPPED_NAMES | FURNITURE and words & SKIPPED_NAMES - TOPICS for words in names)


class Events(HTMLParser):
    """Lines of a page: [text, link characters, tags, region, article]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int]] = []  # tag, skipped, region, article
        self.count: collections.Counter[str] = collections.Counter()  # open elements by tag
        self.blocks: list[int] = []  # places of open block elements
        self.in_tag = False
        self.lines: list[list] = []
        self.buffer: list[str] = []
        self.linked = self.tags = self.links = self.regions = self.articles = self.coloured = 0

    def parse_starttag(self, i):
        self.in_tag = True  # what the parser makes of a broken tag is no text
        try:
            return super().parse_starttag(i)
        finally:
            self.in_tag = False

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)

    def finish(self) -> list[list]:
        if re.match("<[a-zA-Z/!?]", self.rawdata):
            self.rawdata = ""
        self.close()
        self.flush()
        return self.lines

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            _, _, region, article = self.open[-1] if self.open else ("", False, 0, 0)
            self.lines.append([text, self.linked, self.tags, region, article])
        self.buffer, self.linked, self.tags = [], 0, 0

    def handle_starttag(self, tag, attrs):
        while self.open and tag in ENDED_BY.get(self.open[-1][0], ()):
            self._close()
        # inline elements left open in a paragraph don't keep it open
        if tag in BLOCKS and self.blocks and tag in ENDED_BY.get(self.open[k := self.blocks[-1]][0], ()):
            while len(self.open) > k:
                self._close()
        if tag in BLOCKS:
            self.flush()
        self.tags += not self.coloured  # tags within preformatted text colour it
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        _, skipped, region, article = self.open[-1] if self.open else ("", False, 0, 0)
        if not skipped and (skipped := self._never(tag, attrs, article)):
            self.flush()
        if tag in REGIONS and not (tag == "td" and article):  # cells in an article are of a table, not a layout
            self.regions += 1
            region = self.regions
        if tag in ("article", "main") and not article:
            self.articles += 1
            article = self.articles
        self.links += tag == "a"
        self.coloured += tag == "pre"
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.count[tag] += 1
        self.open.append((tag, skipped, region, article))

    def _never(self, tag: str, attrs, article: int) -> bool:
        if tag in SKIPPED:
            return not (tag == "header" and article)
        if tag in ("html", "body", "article", "main"):
            own = dict(attrs)
            return tag == "article" and bool(SKIPPED_NAMES & {*re.split(r"[^a-z]+", (own.get("class") or "").lower())})
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in SKIPPED_ROLES:
                return True
            if name == "style" and "display:none" in value.replace(" ", ""):
                return True
            if name in ("class", "id") and SKIPPED_NAMES & {*re.split(r"[^a-z]+", value)}:
                if not article or tag in BLOCKS and tag not in HEADINGS and (name == "class" and tag != "section" or _all_furniture(value)):
                    return True
        return False

    def _close(self) -> None:
        tag, skipped, _, _ = self.open[-1]
        if tag in BLOCKS or skipped and not (len(self.open) > 1 and self.open[-2][1]):
            self.flush()
        self.links -= tag == "a"
        self.coloured -= tag == "pre"
        self.count[tag] -= 1
        self.open.pop()
        if tag in BLOCKS:
            self.blocks.pop()

    def handle_endtag(self, tag):
        self.tags += not self.coloured or tag == "pre"
        if not self.count[tag]:
            if tag == "p":
                self.flush()
            return
        while self.open[-1][0] != tag:
            self._close()
        self._close()

    def handle_data(self, data):
        if self.in_tag or self.open and self.open[-1][1]:
            return
        self.buffer.append(data)
        if self.links > 0:
            self.linked += len(data)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends are weighed by what lies within."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, kernel)[reach : reach + len(x)] / np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """The value that parts x in two clusters of the least variance within; the least value if there is one cluster."""
    v = np.sort(x)
    if len(v) < 2 or v[-1] - v[0] < 1e-9:
        return float(v[0])
    n = np.arange(1, len(v))
    low, total = np.cumsum(v)[:-1], v.sum()
    between = n * (len(v) - n) * (low / n - (total - low) / (len(v) - n)) ** 2
    k = int(np.argmax(between))
    gap = (v[k + 1 :].mean() - v[: k + 1].mean()) > np.log(3)
    return float(v[k + 1]) if gap else float(v[0])


def main_text(html: str) -> str:
    """The blocks of the main text, joined by blank lines."""
    events = Events()
    events.feed(html)
    lines = events.finish()
    if not lines:
        return ""
    own = np.array([max(len(t) - link, 0) for t, link, _, _, _ in lines], float)
    size = np.array([len(t) for t, *_ in lines], float)
    region, article = (np.array([x[i] for x in lines]) for i in (3, 4))
    inside = article > 0
    ratio = own / np.maximum(np.array([n for _, _, n, _, _ in lines]), 1)
    for part in (inside, ~inside):
        if part.any():
            ratio[part] = np.log1p(smooth(ratio[part]))
    upper = ratio >= threshold(ratio)
    total = lambda keys, values: np.bincount(keys, values)[keys]
    menu = total(region, own) < 0.4 * total(region, size)
    if inside.any() and own[inside].sum() >= 0.5 * own.sum():
        upper |= inside & (ratio >= np.log1p(PROSE))
        menu &= ~inside | (total(region, size) < 0.5 * total(article, size))
    keep = (total(region, size * upper) >= 0.5 * total(region, size)) & ~menu
    if not keep.any():
        keep = region == region[np.argmax(total(region, own))]
    return "\n\n".join(x[0] for x, k in zip(lines, keep.tolist(), strict=True) if k)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def extract(batches):
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
