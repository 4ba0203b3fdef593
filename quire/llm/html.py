"""HTML extraction by text-to-tag ratios.

The standard library's parser streams a page as events. They are cut into lines at line feeds and at the tags that
begin or end a block; each line has its visible characters and its number of tags. The ratio of the two is smoothed by a
Gaussian over the page's lines, and lines whose smoothed ratio reaches a share of the page's standard deviation are
one cluster, the content; the rest is navigation and the like.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.runtime import prepare

#: Standard deviation of the Gaussian in lines, how many of them it reaches, and the threshold in deviations of the smoothed ratios.
SIGMA, REACH, THRESHOLD = 1.0, 3.0, 0.5
BLOCKS = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li "
    "main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
HIDDEN = frozenset("head iframe noscript script style svg template textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_COMMENT_END = re.compile(r"--\s*>")
#: Numbers of characters that are too long to be read; none of them names a character.
_ENDLESS = re.compile(r"&#[0-9]{4000,};?")


class Lines(HTMLParser):
    """The lines of a page: visible text without outer white space, and tags.

    Takes time in proportion to the page, whatever is left open in it: an end that isn't there is looked for once.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self._comment_end = self._section_end = -1
        self.texts: list[str] = []
        self.tags: list[int] = []
        self._parts: list[str] = []
        self._n = 0
        self._hidden: list[str] = []
        self._open: Counter[str] = Counter()  # of the hidden ones, by name

    def read(self, page: str) -> tuple[list[str], np.ndarray]:
        """Texts and numbers of tags of the page's lines."""
        page = _ENDLESS.sub("\ufffd", page)
        # nothing that begins after the last > has an end: it is text
        cut = page.rfind(">") + 1
        for found in _COMMENT_END.finditer(page, 0, cut):
            self._comment_end = found.start()
        self._section_end = page.rfind("]]>")
        self.rawdata = page[:cut]
        self.goahead(1)  # all at once, so that places in rawdata are those in the page
        if self.cdata_elem is None:
            self.handle_data(unescape(page[cut:]))
        self.cut()
        return self.texts, np.array(self.tags, np.int64)

    def parse_comment(self, i: int, report: int = 1) -> int:
        return super().parse_comment(i, report) if i + 4 <= self._comment_end else -1

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A section of characters is skipped up to its end; what else begins like one is a comment up to the next >."""
        if self.rawdata[i : i + 9].lower() == "<![cdata[" and i + 9 <= self._section_end:
            return self.rawdata.find("]]>", i + 9) + 3
        return self.parse_bogus_comment(i)

    def cut(self) -> None:
        if self._n or self._parts:
            text = " ".join("".join(self._parts).split())
            if text or self._n:
                self.texts.append(text)
                self.tags.append(self._n)
        self._parts, self._n = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.cut()
        self._n += 1
        if tag in HIDDEN:
            self._hidden.append(tag)
            self._open[tag] += 1
        elif tag == "body" or self._hidden and self._hidden[-1] in ("head", "title") and tag in BLOCKS:
            self._hidden, self._open = [], Counter()  # a head that was never closed

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in HIDDEN:
            self.handle_starttag(tag, attrs)
        else:
            self._n += 1

    def handle_endtag(self, tag: str) -> None:
        self._n += 1
        while self._open[tag] and self._hidden:
            last = self._hidden.pop()
            self._open[last] -= 1
            if last == tag:
                break
        if tag in BLOCKS:
            self.cut()

    def handle_data(self, data: str) -> None:
        if self._hidden:
            return
        first, *more = data.split("\n")
        self._parts.append(first)
        for part in more:
            self.cut()
            self._parts.append(part)


def smoothed(ratio: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average over the neighbouring lines; at the page's ends over those that there are."""
    if sigma <= 0 or not len(ratio):
        return ratio.astype(float)
    reach = int(np.ceil(REACH * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratio, kernel)[reach : reach + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]


def content(html: str, sigma: float = SIGMA, threshold: float = THRESHOLD) -> tuple[str, int, int]:
    """Text of the content lines, their number, and the number of all lines with text or tags."""
    texts, tags = Lines().read(html)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ratio = smoothed(size / np.maximum(tags, 1), sigma)
    if not size.any():
        return "", 0, len(texts)
    chosen = np.flatnonzero((ratio >= threshold * ratio.std()) & (size > 0)) if len(ratio) > 1 else np.flatnonzero(size)
    return "\n".join(texts[i] for i in chosen), len(chosen), len(texts)


def _run(sigma: float, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).to_pylist()
            for at in range(0, len(column), 500):
                out = [(None, 0, 0) if x is None else content(x, sigma, threshold) for x in column[at : at + 500]]
                text, kept, lines = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(out)), pa.array(text, pa.string()), pa.array(kept, pa.int32()), pa.array(lines, pa.int32())],
                    names=["page_id", "text", "n_content", "n_lines"],
                )

    return run


def extract(pages: DataFrame, sigma: float = SIGMA, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, text, n_content, n_lines for every row of pages.

    Script, style, head and the like aren't visible. A null page has a null text, one without visible text an empty one. A page of
    one line is content. A ratio at the threshold is content. Tags that are never closed end with the page; a tag or comment whose own end is
    missing is text up to the next >. Sections as <![CDATA[ ]]> are skipped and what else begins with <![ is a comment. The whole page is
    parsed however long it is, in time in proportion to its length. Repeated rows and null ids are rows like any other; other columns are not read. An
    empty table gives no rows.
    """
    prepare(pages.sparkSession)
    id_type = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInArrow(_run(sigma, threshold), f"page_id {id_type}, text string, n_content int, n_lines int")
