"""Tolerant reading of markup that isn't well formed: table rows and links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame


class _Rows(HTMLParser):
    """Cells of table rows as text in which only anchors are kept. A cell left open ends with its row; rows of nested
    tables are rows of their own."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.open: list[tuple[list[str], list[str] | None]] = []

    def _end_cell(self) -> None:
        if self.open and self.open[-1][1] is not None:
            cells, text = self.open[-1]
            cells.append("".join(text or []).strip())
            self.open[-1] = (cells, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.open.append(([], None))
        elif tag in ("td", "th") and self.open:
            self._end_cell()
            self.open[-1] = (self.open[-1][0], [])
        elif tag == "a" and self.open and self.open[-1][1] is not None:
            self.open[-1][1].append(f"<a href=\"{dict(attrs).get('href') or ''}\">")

    def handle_endtag(self, tag: str) -> None:
        if tag == "tr" and self.open:
            self._end_cell()
            cells, _ = self.open.pop()
            if cells:
                self.rows.append(cells)
        elif tag in ("td", "th"):
            self._end_cell()
        elif tag == "a" and self.open and self.open[-1][1] is not None:
            self.open[-1][1].append("</a>")

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1] is not None:
            self.open[-1][1].append(data)


class _Links(HTMLParser):
    """(href, label) of anchors, and sources of frames and embedded objects, in document order."""

    TARGETS = {"iframe": "src", "embed": "src", "object": "data"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.links: list[list[str]] = []
        self.at: int | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag == "a":
            self.at = None
            if named.get("href"):
                self.links.append([named["href"], ""])
                self.at = len(self.links) - 1
        elif named.get(self.TARGETS.get(tag, "")):
            self.links.append([named[self.TARGETS[tag]], ""])

    def handle_data(self, data: str) -> None:
        if self.at is not None:
            self.links[self.at][1] += data

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.at = None


def table_rows(html: str | None) -> list[list[str]]:
    parser = _Rows()
    parser.feed(html or "")
    parser.close()
    return parser.rows


def pdf_links(html: str | None) -> list[tuple[str, str]]:
    """(filename, url) of the PDF links of a page, each url once, in document order."""
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    found: dict[str, str] = {}
    for href, label in parser.links:
        if href.lower().split("?")[0].endswith(".pdf") and href not in found:
            found[href] = " ".join(label.split()) or href.rsplit("/", 1)[-1]
    return [(name, href) for href, name in found.items()]


def read_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page_key, row_no, cells) of the table rows of pages."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(str(k), i, cells) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, cells in enumerate(table_rows(h))]
            if out:
                kinds = (pa.string(), pa.int32(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_key", "row_no", "cells"])

    return pages.select(key, html).mapInArrow(scan, "page_key string, row_no int, cells array<string>")


def read_pdf_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(page_key, place, filename, url) of the PDF links of pages."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(str(k), i, n, u) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (n, u) in enumerate(pdf_links(h))]
            if out:
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_key", "place", "filename", "url"])

    return pages.select(key, html).mapInArrow(scan, "page_key string, place int, filename string, url string")
