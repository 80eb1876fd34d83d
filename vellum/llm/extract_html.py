"""Main text of web pages from streamed parser events and smoothed text-to-tag ratios.

The standard library's HTML parser emits events in page order. Text between two block
boundaries is one line; a line carries its text length and the number of tags inside it and
since the line before, those of left out elements aside. Lines below elements that hold no article text by their meaning
(navigation, forms, scripts, ...) or by their class, id or role (menu, advert, comment, ...)
never become candidates. On every page the text-to-tag ratios of the lines are smoothed with a
Gaussian window and split by a threshold into two clusters; lines of
``RUNNING`` characters a tag are content beside any longer ones. A marked
article (``article``, ``main`` or the equivalent role) is a feature only: its lines' ratios weigh
``ARTICLE`` times as much.

Clusters select regions: each row of content lines grows to the marked article around it, else to the smallest
container (a division, section or cell below the body) that holds most of its text. All lines of a region are main text, headlines, short
paragraphs and table rows included; only lines of mere links, themselves below the threshold, are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bounded_batches, read

# Element names of HTML.
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose whole content is not article text.
DROPPED = frozenset(
    "nav header footer aside form script style noscript template head title button select option textarea iframe "
    "object svg math canvas audio video map menu dialog datalist fieldset label legend".split())
#: Elements that end a line before and after them. Others are inline.
BLOCK = frozenset(
    "address article blockquote body caption center dd details dir div dl dt figcaption figure h1 h2 h3 h4 h5 h6 "
    "hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An open paragraph ends where one of these begins.
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that a region may be.
CONTAINER = frozenset("article main section div td".split())
#: Words in class, id or role that mark what is not article text.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie "
    "cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login menu "
    "nav navbar navigation breadcrumb breadcrumbs sidebar side aside header masthead footer comment comments disqus "
    "reply replies respond discussion share sharing social related recommended recommendations widget toolbar pagination pager "
    "tags taglist copyright legal disclaimer complementary contentinfo search skip hidden".split())
#: Such a word says that something is elsewhere on the page, not that this is it ("has-sidebar").
QUALIFIER = frozenset("has with no not without is".split())
#: Marks that inside an article belong to its own head.
OWN_HEAD = frozenset("header masthead".split())
#: Weight of the text-to-tag ratio of a line in a marked article.
ARTICLE = 5.0
#: Smoothed characters a tag from which on a line is running text on any page.
RUNNING = 15.0
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _words(name: str) -> set[str]:
    return set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))


def boilerplate(attrs: list[tuple[str, str | None]], in_article: bool = False) -> bool:
    """Whether class, id, role or a hiding attribute marks an element as no article text."""
    marks = BOILERPLATE - OWN_HEAD if in_article else BOILERPLATE
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key in ("class", "id", "role") and value:
            if any(w & marks and not w & QUALIFIER for w in map(_words, value.split())):
                return True
    return False


class _Lines(HTMLParser):
    """Collects lines (text, tags, in an article, link characters, innermost container) from parser events. Containers are numbered
    in page order, so that the descendants of one have the numbers up to its ``last``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int]] = []
        self.open: list[tuple[str, bool, bool, int]] = []  # element, its content is dropped, it is the article, the container before
        self.dropped = self.article = self.links = self.linked = 0
        self.parts: list[str] = []
        self.tags = 0
        # of every container: the one around it, the article around it (or itself), its last descendant; 0 is the page
        self.container, self.parent, self.main, self.last = 0, [0], [0], [0]

    def line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append((text, self.tags, self.article > 0, self.linked, self.container))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self.end_p()
        if tag in BLOCK or tag in DROPPED:
            self.line()
        self.tags += not self.dropped
        if tag == "body":  # a page may leave its head open
            self.unnest(0)
            self.open, self.dropped, self.article, self.tags, self.links = [], 0, 0, 1, 0
        if tag == "br" and not self.dropped:  # white space inside a block
            self.parts.append(" ")
        if tag in VOID:
            return
        marked = tag not in ("html", "body") and boilerplate(attrs, self.article > 0)
        main = (tag in ("article", "main") or ("role", "main") in attrs) and not marked
        drop = marked or tag in DROPPED and not (tag == "header" and self.article)
        self.open.append((tag, drop, main, self.container))
        self.dropped += drop
        self.article += main
        self.links += tag == "a"
        if tag in CONTAINER or main:
            self.parent.append(self.container)
            self.container = len(self.parent) - 1
            self.main.append(self.container if main else self.main[self.parent[-1]])
            self.last.append(0)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag in ("svg", "iframe", "canvas"):
            self.handle_endtag(tag)

    def end_p(self) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == "p":
                self.end(k)
                return
            if self.open[k][0] in BLOCK or self.open[k][0] in DROPPED:
                return

    def end(self, k: int) -> None:
        self.line()
        for tag, drop, main, _ in self.open[k:]:
            self.dropped -= drop
            self.article -= main
            self.links -= tag == "a"
        self.unnest(self.open[k][3])
        del self.open[k:]

    def unnest(self, container: int) -> None:
        """Ends the containers inside ``container``."""
        while self.container != container:
            self.last[self.container] = len(self.parent) - 1
            self.container = self.parent[self.container]

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.dropped
        if tag in BLOCK or tag in DROPPED:
            self.line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.end(k) if tag in BLOCK or tag in DROPPED else self.unwind(k)
                return

    def unwind(self, k: int) -> None:
        """An inline end tag closes its element, not the blocks opened since."""
        if not any(t in BLOCK or t in DROPPED for t, _, _, _ in self.open[k + 1:]):
            tag, drop, main, before = self.open[k]
            if main and self.container != before:  # an inline element with the role of the article
                self.unnest(before)
            del self.open[k]
            self.dropped -= drop
            self.article -= main
            self.links -= tag == "a"

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)
            if self.links:
                self.linked += len("".join(data.split()))


def smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian window over the lines, renormalised at the ends."""
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    mass = np.convolve(np.ones(len(ratio)), kernel, "full")[reach:reach + len(ratio)]
    return np.convolve(ratio, kernel, "full")[reach:reach + len(ratio)] / mass


def content_lines(ratio: np.ndarray, sigma: float, factor: float) -> np.ndarray:
    """Threshold clustering of the smoothed ratios: content lies above ``factor`` of their range or is running
    text; if the lines hardly differ, above ``factor`` times their standard deviation or half the mean."""
    s = smooth(np.log1p(ratio), sigma)
    return s >= min(factor * s.std(), 0.5 * s.mean()) if len(s) < 3 or s.std() < 0.2 * s.mean() else (
        s >= min(s.min() + factor * (s.max() - s.min()), np.log1p(RUNNING)))


def grow(page: _Lines, seeds: np.ndarray) -> np.ndarray:
    """The lines of the regions that the seeds select: of every row of seeds, the marked article around the smallest container with
    more than half of its text, else that container; a row below no container stays as it is. Link lines are left out."""
    keep = seeds.copy()
    sizes = [len(text) for text, *_ in page.lines]
    home = np.array([line[4] for line in page.lines])
    mere_links = np.array([2 * line[3] >= len("".join(line[0].split())) for line in page.lines])
    edges = np.flatnonzero(np.diff(np.concatenate([[0], seeds.astype(np.int8), [0]])))
    done: set[int] = set()
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        text: dict[int, int] = {}
        for k in range(a, b):
            text[int(home[k])] = text.get(int(home[k]), 0) + sizes[k]
        half, waiting = sum(text.values()) / 2, [-c for c in text]
        heapify(waiting)
        while waiting:  # inner containers first: they have higher numbers
            c = -heappop(waiting)
            if text[c] > half or not c:
                break
            up = page.parent[c]
            if up not in text:
                heappush(waiting, -up)
            text[up] = text.get(up, 0) + text[c]
        region = page.main[c] or c
        if region and region not in done:
            done.add(region)
            keep |= (home >= region) & (home <= page.last[region]) & ~mere_links
    return keep


def main_text(html: str | None, sigma: float = 1.0, factor: float = 0.4) -> str:
    """Main text of one page, blocks joined by one newline; empty for a null or empty page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    HTMLParser.close(parser)
    parser.line()
    parser.unnest(0)
    lines = parser.lines
    if not lines:
        return ""
    ratio = np.array([len(text) / max(1, tags) * (ARTICLE if inside else 1.0) for text, tags, inside, _, _ in lines])
    keep = grow(parser, content_lines(ratio, sigma, factor))
    return "\n".join(line[0] for line, kept in zip(lines, keep, strict=True) if kept)


def extract_main_text(pages: DataFrame, html: str = "html", sigma: float = 1.0, factor: float = 0.4) -> DataFrame:
    """Adds ``text`` (the page's main text) and ``n_chars`` (its code points) to ``pages`` and
    leaves out ``html``.

    One narrow pass over Arrow batches. Null and empty pages give an empty text; pages of any
    length are parsed whole; repeated rows stay; columns named ``text`` or ``n_chars`` are
    replaced.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x, sigma, factor) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])

    bounded_batches(pages.sparkSession)
    source = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(html).alias("html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    out = source.mapInArrow(run, f"{fields}{', ' if fields else ''}text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
