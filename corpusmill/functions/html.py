"""Plain text of web pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = set("p div br li ul ol tr table h1 h2 h3 h4 h5 h6 section article header footer blockquote pre hr td th dt dd".split())
HIDDEN = set("script style noscript template head svg nav".split())


class Reader(HTMLParser):
    """Collects visible text; blocks start new lines, hidden elements are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden.append(tag)
        elif tag in BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden and self.hidden.pop() != tag:
                pass
        elif tag in BLOCK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def page_text(page: str | bytes | None) -> str | None:
    """The visible text of a page: bytes are utf-8, else the charset the page names, else Latin-1."""
    if page is None:
        return None
    if isinstance(page, bytes):
        try:
            page = page.decode("utf-8")
        except UnicodeDecodeError:
            named = re.search(rb"charset=[\"']?([\w-]+)", page[:2048], re.I)
            try:
                page = page.decode(named[1].decode() if named else "latin-1", "replace")
            except LookupError:
                page = page.decode("latin-1")
    reader = Reader()
    try:
        reader.feed(page)
        reader.close()
        text = "".join(reader.parts)
    except Exception:  # a page that can't be parsed loses its tags
        text = html.unescape(re.sub(r"<[^>]*>", " ", page))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def html_text(page: Column | str) -> Column:
    """Visible text of string or binary pages; null stays null."""

    @F.pandas_udf("string")
    def read(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(lambda p: page_text(bytes(p) if isinstance(p, (bytearray, memoryview)) else p))

    return read(page)
