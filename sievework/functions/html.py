"""The one scalar that has no native form: HTML to readable text, as an Arrow function with the standard parser."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.parts.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def readable(text: str | None) -> str:
    """Character references decoded twice, tags as spaces, blanks collapsed, three line ends or more as two."""
    text = html.unescape(html.unescape(text or ""))
    if "<" in text and ">" in text:
        parser = _Text()
        parser.feed(text)
        parser.close()
        text = "".join(parser.parts)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def _readable(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield pd.Series([readable(x) for x in s], dtype=object)


def clean_html(text: Column) -> Column:
    return F.pandas_udf(_readable, "string")(text)
