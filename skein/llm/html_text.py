"""Operator 9, main text of HTML: streaming parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard-library parser's events give lines: blocks of text with the number of tags met in each. A line's ratio is its
characters by its tags. Lines that are marked as something else than the article's text (inside menus, footers, asides and the
like, by tag, role or whole class words, or made of links for the most part) count with FAINT of their ratio. The ratios are
smoothed with a Gaussian over the lines, weighed with the line's own, and clustered about a threshold: lines above it are
content. Content lines select the regions of the page:

* the run of unmarked lines, from one marked line to the next, that a content line stands in;
* the section, article or main element that a content line stands in, and all articles where one holds content;
* a marked line only if it is content itself.

All unmarked lines of these regions are the text, short ones too; a page without content has none. Scripts, styles, controls and
what is hidden from everyone (`hidden`, `display: none`) have no lines. Inside an article or main element class words count only
for adverts, comments and sidebars, and links mark nothing: a paragraph that is one link is a paragraph. A form's lines are
marked, but for an article or main element in it, and but for forms that hold most of a page's unmarked text: these wrap the page.
What counts as content is measured by the page's own ratios, so wrappers of any depth change nothing; a page whose lines are all
marked has no text.

Defined results: null and empty html give the empty text; equal pages have equal text; unclosed and crossed tags end as
HTML's own rules for paragraphs, items and cells end them, else with their parent, in time linear in the page; white space is
what Unicode calls so; repeated rows are extracted each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())  # fmt: skip
#: Elements that have no lines.
GONE = frozenset("head script style noscript template button select textarea label iframe object svg math canvas audio video title".split())
#: Elements and roles that mark their lines.
MARKS = frozenset("nav footer aside dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status".split())
#: Whole class and id words that mark lines: anywhere, and outside articles.
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising sponsored comment comments comment-list commentlist disqus sidebar".split())
WORDS = ALWAYS | frozenset(
    "banner breadcrumb breadcrumbs consent cookie cookies dialog disclaimer footer gdpr header infobar login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion related replies respond search share sharing signup "
    "skip social sponsor subscribe subscription toolbar topbar widget widgets".split())  # fmt: skip
SECTIONS = frozenset("article main section div td".split())
ARTICLES = frozenset(("article", "main"))
#: A start tag of the first kind ends open elements of the second, and paragraphs, up to the nearest element of SCOPE.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body article section div main html".split())
#: What a marked line's ratio counts, the share of linked text that marks a line, and the least score of content by the best unmarked ratio.
FAINT, LINKED, LEAST = 1e-4, 0.6, 1e-3
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Line:
    text: str
    tags: int
    links: int  # characters inside links
    marked: bool
    section: int  # number of the nearest section element
    article: bool
    form: bool = False  # marked by a form alone


class Lines(HTMLParser):
    """The lines of a page. Open elements are a stack; places in it are kept by tag, so that none is walked over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag, and the number of the section that it began, or -1
        self.at: dict[str, list[int]] = {}
        self.scopes, self.blocks, self.marks, self.gone, self.articles, self.anchors, self.forms = ([] for _ in range(7))
        self.sections: list[int] = [0]
        self.spans: list[list[int]] = [[0, -1, 0]]  # first line, end line, whether it is an article, of each section
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[Line] = []

    def flush(self) -> None:
        if self.text:
            t = " ".join("".join(self.text).split())
            if t:
                marked = bool(self.marks) or (not self.articles and self.linked >= LINKED * len(t))
                form = bool(self.forms) and not (self.articles and self.articles[-1] > self.forms[-1])
                self.lines.append(Line(t, self.tags, self.linked, marked or form, self.sections[-1], bool(self.articles), form and not marked))
                self.tags = 0
            self.text, self.linked = [], 0

    def pop_to(self, place: int) -> None:
        """Close the elements from this place of the stack on."""
        while len(self.stack) > place:
            tag, number = self.stack.pop()
            self.at[tag].pop()
            if number >= 0:
                self.spans[number][1] = len(self.lines)
                self.sections.pop()
        for held in (self.scopes, self.blocks, self.marks, self.gone, self.articles, self.anchors, self.forms):
            while held and held[-1] >= place:
                held.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append("\n")
            return
        if tag in BLOCKS:
            self.flush()
            if tag not in ("html", "body"):
                over = self.scopes[-1] if self.scopes else -1
                ended = [p[i] for t in ("p", *ENDS.get(tag, ())) if (p := self.at.get(t)) and (i := bisect_right(p, over)) < len(p)]
                if ended:
                    self.pop_to(min(ended))
        if tag in VOID:
            return
        place = len(self.stack)
        gone, marked = self.meant(tag, attrs)
        if marked and not self.marks:
            self.flush()
        number = -1
        if tag in SECTIONS:
            number = len(self.spans)
            self.spans.append([len(self.lines), -1, int(tag in ARTICLES)])
            self.sections.append(number)
        self.stack.append((tag, number))
        self.at.setdefault(tag, []).append(place)
        for held, yes in ((self.scopes, tag in SCOPE), (self.blocks, tag in BLOCKS), (self.marks, marked), (self.gone, gone), (self.articles, tag in ARTICLES), (self.anchors, tag == "a"), (self.forms, tag == "form")):
            if yes:
                held.append(place)

    def meant(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether an element has no lines, and whether its lines are marked."""
        gone, marked = tag in GONE, tag in MARKS or (tag == "header" and not self.articles)
        for k, v in attrs:
            if k == "hidden" or (k == "style" and v and HIDDEN.search(v)):
                gone = True
            elif k == "role" and v and v.lower() in ROLES:
                marked = True
            elif k in ("class", "id") and v and tag not in ("html", "body", *ARTICLES):
                known = ALWAYS if self.articles else WORDS
                marked = marked or any(w.rstrip("-_0123456789") in known for w in v.lower().split())
        return gone, marked

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        ends = tag in BLOCKS or tag in GONE
        if tag in BLOCKS:
            self.flush()
        if places := self.at.get(tag):
            place = places[-1]
            # an inline end tag does not end the blocks opened inside its element
            if ends or not (self.blocks and self.blocks[-1] > place):
                if self.marks and self.marks[-1] >= place:
                    self.flush()
                self.pop_to(place)

    def handle_data(self, data: str) -> None:
        if self.gone:
            return
        self.text.append(data)
        if self.anchors:
            self.linked += len(" ".join(data.split()))

    def done(self) -> list[Line]:
        HTMLParser.close(self)  # what the parser still holds of a page cut short is text
        self.flush()
        self.pop_to(0)
        self.spans[0][1] = len(self.lines)
        inside, outside = (sum(len(x.text) for x in self.lines if yes(x)) for yes in (lambda x: x.form, lambda x: not x.marked))
        if inside > outside:
            for x in self.lines:
                x.marked = x.marked and not x.form
        return self.lines


def smoothed(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """x under a Gaussian of the given width, ends weighted by what is there."""
    r = max(1, round(3 * sigma))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k, "full")[r:-r] / np.convolve(np.ones(len(x)), k, "full")[r:-r]


def threshold(x: np.ndarray) -> float:
    """The middle between two clusters of x, from its mean until both settle; one at the least."""
    t = float(x.mean())
    for _ in range(32):
        low, high = x[x <= t], x[x > t]
        if not len(low) or not len(high):
            break
        if abs((nxt := float(low.mean() + high.mean()) / 2) - t) < 1e-9:
            break
        t = nxt
    return max(1.0, min(t, float(x.max())))


def content(lines: list[Line]) -> np.ndarray:
    """Which lines the clustering takes for content."""
    plain, marked = np.array([len(x.text) / max(1, x.tags) for x in lines]), np.array([x.marked for x in lines])
    ratio = np.where(marked, FAINT * plain, plain)
    score = np.sqrt(smoothed(ratio) * ratio) / (LEAST * plain[~marked if not marked.all() else marked].max())
    return score >= threshold(score)


def main_text(html: str) -> str:
    """The article's blocks, joined by an empty line."""
    p = Lines()
    p.feed(html)
    lines = p.done()
    if not lines:
        return ""
    yes, marked = content(lines), np.array([x.marked for x in lines])
    run = np.cumsum(marked)  # unmarked lines with no marked one between them have one number
    keep = np.isin(run, run[yes & ~marked])
    held = {x.section for x, c in zip(lines, yes) if c and not x.marked and x.section}
    if any(x.article for x, c in zip(lines, yes) if c):
        held |= {i for i, s in enumerate(p.spans) if s[2]}
    cover = np.zeros(len(lines) + 1, dtype="int64")
    for i in held:
        cover[p.spans[i][0]] += 1
        cover[p.spans[i][1]] -= 1
    keep = (keep | (np.cumsum(cover[:-1]) > 0)) & ~marked | (marked & yes)
    return "\n\n".join(x.text for x, k in zip(lines, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch, 2):
                part = batch.slice(a, z - a)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(released(run), "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html_text": op9_html_text}
ORACLE: dict[str, str] = {}
