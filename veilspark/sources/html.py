"""HTML text into text nodes and elements, one page per row, in document order.

Entities are decoded as a browser decodes them. Null and empty pages have no
nodes; broken markup is read as far as it goes; pages are parsed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_NODES = "page_id BIGINT, ord INT, parent_tag STRING, text STRING"
ELEMENTS = "page_id BIGINT, ord INT, tag STRING, type STRING, name STRING, id STRING, placeholder STRING, aria_label STRING, data_testid STRING, data_test STRING, aria_labelledby STRING, autocomplete STRING, role STRING, href STRING, value STRING"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ATTRIBUTES = [c.split()[0] for c in ELEMENTS.split(", ")[3:]]


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.texts: list[tuple[str | None, str]] = []
        self.elements: list[tuple] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k.replace("-", "_"): v if v is not None else "" for k, v in attrs}
        self.elements.append((tag, *(a.get(n) for n in _ATTRIBUTES)))
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1] == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.texts.append((self.open[-1] if self.open else None, data))


def _read(page: str | None) -> _Reader:
    reader = _Reader()
    if page:
        reader.feed(page)
        reader.close()
    return reader


def text_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """``TEXT_NODES`` of ``pages(page_id, html)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, i, tag, t) for p, h in zip(b.iloc[:, 0], b.iloc[:, 1]) for i, (tag, t) in enumerate(_read(h).texts)], columns=["page_id", "ord", "parent_tag", "text"])

    return pages.select(F.col("page_id").cast("bigint"), F.col(html).cast("string")).mapInPandas(run, TEXT_NODES)


def html_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """``ELEMENTS`` of ``pages(page_id, html)``; what only layout knows (rects, visibility) isn't there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, i, *e) for p, h in zip(b.iloc[:, 0], b.iloc[:, 1]) for i, e in enumerate(_read(h).elements)], columns=["page_id", "ord", "tag", *_ATTRIBUTES])

    return pages.select(F.col("page_id").cast("bigint"), F.col(html).cast("string")).mapInPandas(run, ELEMENTS)


def acceptable(nodes: DataFrame) -> DataFrame:
    """Text nodes worth scanning: six characters at least, with a parent, not in scripts or styles."""
    trimmed = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    return nodes.where((F.length(trimmed) >= 6) & F.col("parent_tag").isNotNull() & ~F.col("parent_tag").isin("script", "style", "noscript"))
