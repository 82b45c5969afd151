"""Tables and titles in web pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.names import quoted
from siltworks.sources.cells import cells_to_columns

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
ROW_FIELDS = "table_idx int, row_idx int, header array<string>, cells array<string>, error string"
NO_TABLE = "no table in page"
# The most places a cell may span, by the HTML standard.
MOST_SPANNED = {"colspan": 1_000, "rowspan": 65_534}


class _FirstTableRead(Exception):
    pass


def _span(text: str | None, most: int) -> int:
    """A span as written, within the standard's limit; 1 if it is no whole number."""
    digits = (text or "").strip()
    if not (digits.isascii() and digits.isdigit()):
        return 1
    # A number of many digits is over any limit and need not be converted.
    return most if len(digits.lstrip("0")) > 6 else min(int(digits), most)


class _Tables(HTMLParser):
    """Collects rows as (table, is_header, cells); nested tables get their own number."""

    def __init__(self, first_only: bool = False):
        super().__init__(convert_charrefs=True)
        self.first_only = first_only
        self.rows: list[tuple[int, bool, list[str]]] = []
        self.count = 0
        self.open: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"idx": self.count, "row": None, "cell": None, "head": False, "spans": {}})
            self.count += 1
        elif self.open:
            table = self.open[-1]
            if tag == "thead":
                table["head"] = True
            elif tag in ("tbody", "tfoot"):
                self._end_row(table)
                table["head"] = False
            elif tag == "tr":
                self._end_row(table)
                table["row"] = []
            elif tag in ("td", "th"):
                self._end_cell(table)
                if table["row"] is None:
                    table["row"] = []
                spans = {k: _span(v, MOST_SPANNED[k]) for k, v in attrs if k in MOST_SPANNED}
                table["cell"] = {"th": tag == "th", "text": [], **spans}

    def handle_endtag(self, tag):
        if not self.open:
            return
        table = self.open[-1]
        if tag in ("td", "th"):
            self._end_cell(table)
        elif tag == "tr":
            self._end_row(table)
        elif tag == "thead":
            self._end_row(table)
            table["head"] = False
        elif tag == "table":
            self._end_row(table)
            self.open.pop()
            if self.first_only and not self.open:
                raise _FirstTableRead

    def handle_data(self, data):
        for table in self.open:
            if table["cell"] is not None:
                table["cell"]["text"].append(data)

    def close(self):
        super().close()
        while self.open:
            self._end_row(self.open.pop())

    def _end_cell(self, table):
        if table["cell"] is not None:
            table["row"].append(table["cell"])
            table["cell"] = None

    def _end_row(self, table):
        self._end_cell(table)
        row, table["row"] = table["row"], None
        if not row:
            return
        # Spanning cells repeat their text over the places they cover.
        texts, header, spans = [], table["head"] or all(c["th"] for c in row), table["spans"]

        def place(text):
            texts.append(text)

        def carried():
            while len(texts) in spans:
                left, text = spans.pop(len(texts))
                if left > 1:
                    after[len(texts)] = (left - 1, text)
                place(text)

        after: dict[int, tuple[int, str]] = {}
        for c in row:
            carried()
            text = " ".join("".join(c["text"]).split())
            for _ in range(max(c.get("colspan", 1), 1)):
                if c.get("rowspan", 1) > 1:
                    after[len(texts)] = (c["rowspan"] - 1, text)
                place(text)
        carried()
        table["spans"] = after
        self.rows.append((table["idx"], header, texts))


def page_rows(html: str | None, first_only: bool = False) -> list[tuple]:
    """(table, row, header, cells, error) for each body row of one page.

    The leading header row of a table names its columns; without one they are
    numbered from 0. Later header rows are left out. ``first_only`` stops where
    the first table ends.
    """
    parser = _Tables(first_only)
    try:
        parser.feed(html or "")
        parser.close()
    except _FirstTableRead:
        pass
    tables: dict[int, list[tuple[bool, list[str]]]] = {}
    for table, is_header, cells in parser.rows:
        tables.setdefault(table, []).append((is_header, cells))
    found = []
    for table, rows in sorted(tables.items()):
        titled, first = rows[0]
        header = first if titled else [str(i) for i in range(max(len(cells) for _, cells in rows))]
        body = [cells for is_header, cells in rows if not is_header]
        found += [(table, i, header, cells, None) for i, cells in enumerate(body)]
    return found if tables else [(None, None, None, None, NO_TABLE)]


def html_tables(pages: DataFrame, key: str, html: str = "html", first_only: bool = False) -> DataFrame:
    """One row per table row of every page; a page without a table is an error row.

    Parsing has no column expression, so pages pass through pandas in Arrow
    batches. Each page is parsed alone, and there is no shuffle. The text of a
    page without any table tag stays in the JVM.
    """
    text = F.col(quoted(html))
    picked = pages.select(F.col(quoted(key)).alias("_key"), F.when(text.rlike("(?i)<table"), text).alias("_html"))
    key_type = picked.schema["_key"].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["_key", "table_idx", "row_idx", "header", "cells", "error"]
        for batch in batches:
            rows = [(k, *row) for k, page in zip(batch["_key"], batch["_html"]) for row in page_rows(page, first_only)]
            yield pd.DataFrame(rows, columns=columns).astype({"table_idx": "Int32", "row_idx": "Int32"})

    return picked.mapInPandas(parse, f"_key {key_type}, {ROW_FIELDS}").withColumnRenamed("_key", key)


def read_first_tables(pages: DataFrame, key: str, names: list[str], html: str = "html") -> DataFrame:
    """The first table of each page as text columns with the given names."""
    rows = html_tables(pages, key, html, first_only=True).filter(F.col("table_idx") == 0)
    return cells_to_columns(rows, names, [key])


def html_titles(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``title``; null where the page has none."""
    c = F.col(quoted(html))
    title = F.regexp_extract(c, TITLE, 1)
    return pages.withColumn("title", F.when(c.rlike(TITLE), F.trim(title)))
