"""Reading web pages (IO13, UD7)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = {"script", "style", "noscript", "nav", "footer", "header", "form", "aside"}
BODIES = ("main", "article", "body")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

PAGE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("tables", T.ArrayType(T.ArrayType(T.ArrayType(T.StringType())))),
])


class _Page(HTMLParser):
    """Collects text per enclosing body element, the title and the tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.text: dict[str, list[str]] = {b: [] for b in (*BODIES, "")}
        self.started: dict[str, int] = {}
        self.title: list[str] = []
        self.tables: list[list[list[list[str]]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.open.append(tag)
        if tag in BODIES:
            self.started[tag] = self.started.get(tag, 0) + 1
        if SKIPPED.isdisjoint(self.open):
            if tag == "table":
                self.tables.append([])
            elif tag == "tr" and self.tables:
                self.tables[-1].append([])
            elif tag in ("td", "th") and self.tables and self.tables[-1]:
                self.tables[-1][-1].append([])

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not SKIPPED.isdisjoint(self.open):
            return
        if "title" in self.open:
            self.title.append(data.strip())
        if "table" in self.open:
            if ("td" in self.open or "th" in self.open) and self.tables[-1] and self.tables[-1][-1] and data.strip():
                self.tables[-1][-1][-1].append(data.strip())
            return
        for b in BODIES:
            if b in self.open and self.started[b] == 1:
                self.text[b].append(data)
        self.text[""].append(data)

    def result(self) -> dict:
        body = next((b for b in BODIES if b in self.started), "")
        lines = [ln.strip() for ln in "\n".join(self.text[body]).splitlines()]
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(ln for ln in lines if len(ln) > 1))
        tables = []
        for table in self.tables:
            rows = [[" ".join(cell) for cell in row] for row in table]
            rows = [r for r in rows if any(r)]
            if rows:
                tables.append(rows)
        return {"title": "".join(self.title), "text": text, "tables": tables}


def read_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.result()


@F.pandas_udf(PAGE)
def extract_page(html: pd.Series) -> pd.DataFrame:
    """UD7: struct(title, text, tables) of each page."""
    return pd.DataFrame([read_page(h) for h in html], columns=["title", "text", "tables"])
