"""Main text of HTML pages from the text-to-tag ratios of their lines.

The standard library's parser streams events; each block of text becomes a line
with its text length and the number of tags in and before it.  The ratios of the
lines are smoothed with a Gaussian and divided by threshold clustering (two means)
into content and rest.  Of the places in the page (article, main, section, div,
cell, body) that hold content lines, the one with the most content is the region,
taken as deep as it keeps nearly all of it; the region is given back whole, short
lines included, without the parts that are marked as menus, headers, footers,
sidebars, notices, adverts, forms or reader comments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import by_bytes, fresh_name, table, texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that never hold article text.
ASIDE = frozenset(
    "head title nav footer aside form script style noscript template svg math iframe object canvas audio video select button dialog menu datalist textarea".split()
)
# Elements in the flow of a line; any other tag begins a new block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
PLACES = frozenset("article main section div td body blockquote center".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words in a class or id that mark what is not article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar sidebars aside footer masthead comment comments commentlist disqus respond reply replies share sharing social related cookie "
    "cookies consent notice notices notification gdpr alert popup modal overlay newsletter subscribe subscription login signin signup register search "
    "searchform widget widgets pager pagination form forms toolbar skip copyright disclaimer".split()
)
SIGMA = 1.5
KEEP = 0.9
CHUNK = 1 << 16
_words = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])").findall


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if not value:
            continue
        if name in ("class", "id") and tag not in ("body", "html", "main", "article"):
            if any(w.lower() in MARKS for w in _words(value)):
                return True
        elif name == "role" and value.lower() in ROLES:
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class _Lines(HTMLParser):
    """Collects blocks: text, tags, letters in links, and the places they are in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = []  # tag, place, whether set aside
        self.places: list[tuple[int, str]] = [(-1, "page")]  # parent, tag
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, letters in links, place
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0
        self.links = 0

    def _place(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _aside(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self._place()))
                self.tags = 0
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "br" and self.parts:
                self.parts.append(" ")
            self.links += tag == "a"
            if not (tag in ("span", "a", "label", "small") and _marked(tag, attrs)):
                return
        else:
            self.flush()
        if tag in VOID:
            return
        inside = any(t in ("article", "main") for t, _, _ in self.open)
        aside = self._aside() or tag in ASIDE or (tag == "header" and not inside) or _marked(tag, attrs)
        place = self._place()
        if tag in PLACES or tag in INLINE:
            self.places.append((place, tag))
            place = len(self.places) - 1
        if tag in INLINE and aside:
            # A marked element in the flow: what is before it stays part of the line.
            self.open.append((tag, self._place(), True))
        elif tag in PLACES or aside or tag in ("header", "li", "tr", "table", "ul", "ol"):
            self.open.append((tag, place, aside))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in INLINE:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
            if self.open[k][0] in ("article", "main", "body") and tag in INLINE:
                break

    def handle_data(self, data: str) -> None:
        if not self._aside():
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def two_means(values: np.ndarray) -> float:
    """The threshold between the two clusters of least spread; below all if they are equal."""
    ordered = np.sort(values)
    low, high = float(ordered[0]), float(ordered[-1])
    if low == high:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        k = int(np.searchsorted(ordered, cut, side="right"))
        new = float(ordered[:k].mean()), float(ordered[k:].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = np.convolve(np.ones(len(ratios)), weights, "full")[reach : reach + len(ratios)]
    return np.convolve(ratios, weights, "full")[reach : reach + len(ratios)] / inside


def main_text(html: str | None) -> str:
    """The article of a page, one line per block; empty without any."""
    if not html:
        return ""
    parser = _Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    length = np.array([len(t) for t, _, _, _ in lines], dtype=float)
    own = np.maximum(length - [linked for _, _, linked, _ in lines], 0)
    ratio = smoothed(own / np.maximum([tags for _, tags, _, _ in lines], 1))
    weight = np.where(ratio >= two_means(ratio), own, 0)
    if not weight.any():
        weight = own if own.any() else length
    # Content within each place, those inside it included.
    parents = [p for p, _ in parser.places]
    mass = np.zeros(len(parents))
    np.add.at(mass, [place for _, _, _, place in lines], weight)
    for k in range(len(parents) - 1, 0, -1):
        mass[parents[k]] += mass[k]
    named = [k for k, (_, tag) in enumerate(parser.places) if tag in ("article", "main") and mass[k] > 0]
    if named:
        region = max(named, key=lambda k: (mass[k], k))
    else:
        region = 0
        while True:
            inner = [k for k in range(region + 1, len(parents)) if parents[k] == region and mass[k] >= KEEP * mass[region]]
            if not inner:
                break
            region = inner[0]
    within = [False] * len(parents)
    within[region] = True
    for k in range(region + 1, len(parents)):
        within[k] = within[parents[k]]
    chosen = [k for k, line in enumerate(lines) if within[line[3]]]
    if not named:
        # Without a named article, lines that are mostly links at either end are menus.
        solid = [k for k in chosen if weight[k] > 0]
        if solid:
            chosen = [k for k in chosen if solid[0] <= k <= solid[-1] or own[k] >= 0.5 * length[k]]
    return "\n".join(lines[k][0] for k in chosen)


def _extract(html_col: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            texts = [main_text(h) for h in texts_of(batch.column(html_col))]
            kept = [c for c in batch.schema.names if c != html_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, out])

    return run


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every whole page in ``out`` instead of ``html_col``.

    A null or empty page, and one without text, gives an empty text.  All other
    columns and repeated rows are kept; a column named ``out`` is an error.
    """
    others = [c for c in pages.columns if c != html_col]
    if fresh_name(out, others) != out:
        raise ValueError(f"there is a column {out} already")
    schema = pages.drop(html_col).select("*", F.lit("").alias(out)).schema
    return pages.mapInArrow(_extract(html_col, out), schema)


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
