"""HTML pages as rows and text (SRC-18..22), with the standard library's parser in Arrow batches.

Null or broken pages give no rows and null text.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Elements without text of their own, and those that end a line.
SILENT = frozenset("script style noscript nav header footer form svg".split())
BLOCKS = frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article table ul ol".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(data)


def text_of(html: str | None) -> str | None:
    """Readable text of a page: one line per block, blanks squeezed."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    lines = (" ".join(line.split()) for line in "".join(p.out).split("\n"))
    return "\n".join(line for line in lines if line)


@pandas_udf(StringType())
def _text_udf(s: pd.Series) -> pd.Series:
    return s.map(text_of, na_action="ignore")


def html_to_text(html: Column, least: int = 0) -> Column:
    """Text of pages; shorter than ``least`` gives null, for a caller's next choice (SRC-22)."""
    text = _text_udf(html)
    return F.when(F.length(text) >= least, text)


class _Tables(HTMLParser):
    """Rows of all tables: cells as text, with the links in them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[list[str], list[tuple[str, str]]]] = []
        self.cells: list[list[str]] | None = None
        self.links: list[list[str]] = []
        self.open_link: list[str] | None = None

    def _close_row(self) -> None:
        if self.cells:
            self.rows.append(([" ".join("".join(c).split()) for c in self.cells], [(h, " ".join(t.split())) for h, t in self.links]))
        self.cells, self.links = None, []

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close_row()
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append([])
        elif tag == "a" and self.cells is not None:
            href = dict(attrs).get("href")
            self.open_link = [href, ""] if href else None
            if self.open_link:
                self.links.append(self.open_link)

    def handle_endtag(self, tag):
        if tag == "a":
            self.open_link = None
        elif tag in ("tr", "table"):
            self._close_row()

    def handle_data(self, data):
        if self.cells:
            self.cells[-1].append(data)
            if self.open_link:
                self.open_link[1] += data


def table_rows(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(url, row_no, cells, links, link)`` of every table row; links are made absolute, and ``link`` prefers a PDF (SRC-18..21)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for u, h in zip(b["url"], b["html"]):
                if h is None:
                    continue
                p = _Tables()
                p.feed(h)
                p.close()
                p._close_row()
                for i, (cells, links) in enumerate(p.rows):
                    hrefs = [urljoin(u or "", x) for x, _ in links]
                    best = next((x for x in hrefs if x.lower().split("?")[0].endswith(".pdf")), hrefs[0] if hrefs else None)
                    out.append((u, i, cells, hrefs, best))
            yield pd.DataFrame(out, columns=["url", "row_no", "cells", "links", "link"])

    schema = "url string, row_no int, cells array<string>, links array<string>, link string"
    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, schema)


def labelled_fields(rows: DataFrame) -> DataFrame:
    """Detail pages whose rows are label and value, as one map per page (SRC-18, SRC-21); the first value of a label counts."""
    pairs = rows.filter(F.size("cells") >= 2).select("url", "row_no", F.lower(F.rtrim(F.col("cells")[0], F.lit(": "))).alias("k"), F.col("cells")[1].alias("v")).filter("k <> ''")
    first = pairs.groupBy("url", "k").agg(F.min_by("v", "row_no").alias("v"))
    return first.groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields"))


def relation_type(text: Column) -> Column:
    """Kind of an edge by the text of its link (FN-38)."""
    return F.when(text.rlike("Revogad") & text.rlike(r"\bpor\b"), "revoked_by").when(text.rlike("(?i)revog"), "revokes").when(text.rlike("(?i)alter"), "amends").otherwise("correlates")
