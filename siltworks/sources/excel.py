"""Rows of .xlsx workbooks, read from their zipped XML."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltworks.functions.coercion import KINDS, coerce
from siltworks.functions.names import quoted
from siltworks.sources.cells import cells_to_columns

# Fixed values of the workbook format: name spaces, built-in date formats, first day of each calendar.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
DATE_FORMAT_IDS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
EPOCH_1900 = datetime(1899, 12, 30)
EPOCH_1904 = datetime(1904, 1, 1)

ROW_FIELDS = "row_idx int, header array<string>, cells array<string>, error string"
ROWS_PER_BATCH = 5_000
REJECTS = ("fail", "skip")
# What a damaged or encrypted workbook can raise while it is read.
UNREADABLE = (
    zipfile.BadZipFile, zlib.error, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError,
    LookupError, ValueError, OverflowError, AttributeError, TypeError,
)


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]*", reference.upper()).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


class _Workbook:
    def __init__(self, content: bytes):
        self.files = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.files.namelist())
        book = self._xml("xl/workbook.xml")
        properties = book.find(f"{MAIN}workbookPr")
        old_mac = properties is not None and properties.get("date1904") in ("1", "true")
        self.epoch = EPOCH_1904 if old_mac else EPOCH_1900
        sheet = book.find(f"{MAIN}sheets/{MAIN}sheet")
        targets = {r.get("Id"): r.get("Target") for r in self._xml("xl/_rels/workbook.xml.rels").iter(f"{PACKAGE}Relationship")}
        target = targets[sheet.get(f"{RELATION}id")]
        self.sheet = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
        strings = "xl/sharedStrings.xml"
        self.strings = [_text(i) for i in self._xml(strings).iter(f"{MAIN}si")] if strings in names else []
        self.date_styles = self._date_styles() if "xl/styles.xml" in names else set()

    def _xml(self, name):
        return ElementTree.fromstring(self.files.read(name))

    def _date_styles(self) -> set[int]:
        styles = self._xml("xl/styles.xml")
        custom = {}
        for f in styles.iter(f"{MAIN}numFmt"):
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", ""))
            custom[int(f.get("numFmtId"))] = bool(re.search("[ymdhs]", code, re.IGNORECASE))
        formats = styles.find(f"{MAIN}cellXfs")
        found = set()
        for i, style in enumerate(formats if formats is not None else ()):
            number = int(style.get("numFmtId", 0))
            if custom.get(number, number in DATE_FORMAT_IDS):
                found.add(i)
        return found

    def _value(self, cell) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return _text(cell)
        value = cell.find(f"{MAIN}v")
        if value is None or value.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(value.text)]
        if kind == "b":
            return "true" if value.text == "1" else "false"
        if kind == "n" and int(cell.get("s", 0)) in self.date_styles:
            moment = self.epoch + timedelta(microseconds=round(float(value.text) * 86_400_000) * 1_000)
            return moment.isoformat(sep=" ")
        return value.text

    def rows(self) -> Iterator[list[str | None]]:
        """Cells of the first sheet, row by row, without holding the sheet."""
        with self.files.open(self.sheet) as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for cell in node.iter(f"{MAIN}c"):
                    place = _column_number(cell.get("r", "")) if cell.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    cells[place] = self._value(cell)
                node.clear()
                yield cells


def workbook_rows(content: bytes) -> Iterator[tuple]:
    """(row, header, cells, error); row 1 of the sheet holds the titles.

    The sheet is read through once before its first row is given out, so that a
    workbook which breaks half way is one error and never some of its rows.
    """
    try:
        book = _Workbook(content)
        for _ in book.rows():
            pass
        rows = book.rows()
        header = [c or "" for c in next(rows, [])]
        for i, cells in enumerate(rows):
            if any(c is not None for c in cells):
                yield i, header, cells, None
    except UNREADABLE as error:
        yield None, None, None, f"not a readable workbook: {error!r}"


def parse_workbooks(files: DataFrame) -> DataFrame:
    """Rows of a table of workbooks ``(path, content)``.

    One workbook is one task's work; the format ends a sheet at 1,048,576 rows.
    A file that cannot be read gives one row with ``error`` and the rest go on.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "row_idx", "header", "cells", "error"]
        for batch in batches:
            pending = []
            for path, content in zip(batch["path"], batch["content"]):
                for row in workbook_rows(content):
                    pending.append((path, *row))
                    if len(pending) == ROWS_PER_BATCH:
                        yield pd.DataFrame(pending, columns=columns).astype({"row_idx": "Int32"})
                        pending = []
            if pending:
                yield pd.DataFrame(pending, columns=columns).astype({"row_idx": "Int32"})

    return files.select("path", "content").mapInPandas(parse, f"path string, {ROW_FIELDS}")


def workbook_columns(rows: DataFrame, schema: T.StructType, rejects: str = "fail") -> DataFrame:
    """Parsed rows to the typed columns of a schema; cells that do not fit are null.

    A workbook that cannot be read fails the job, or is left out with
    ``rejects="skip"``; :func:`rejected_workbooks` names those.
    """
    if rejects not in REJECTS:
        raise ValueError(f"unknown way with rejects {rejects!r}, use one of {REJECTS}")
    readable = F.col("error").isNull()
    if rejects == "fail":
        refused = F.raise_error(F.concat_ws(": ", "path", "error")).cast("boolean")
        readable = F.when(readable, F.lit(True)).otherwise(refused)
    kinds = {v.typeName(): k for k, v in KINDS.items()}
    text = cells_to_columns(rows.filter(readable), schema.fieldNames(), ["path"])
    typed = []
    for field in schema.fields:
        c, kind = F.col(quoted(field.name)), kinds.get(field.dataType.typeName())
        value = coerce(c, T.StringType(), kind) if kind else c.try_cast(field.dataType)
        typed.append(value.alias(field.name))
    return text.select(*typed)


def rejected_workbooks(rows: DataFrame) -> DataFrame:
    """(path, error) of the workbooks that cannot be read."""
    return rows.filter(F.col("error").isNotNull()).select("path", "error")


def read_workbooks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parsed rows of all .xlsx files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True)
    return parse_workbooks(files.load(path))


def read_excel(spark: SparkSession, path: str | list[str], schema: T.StructType, rejects: str = "fail") -> DataFrame:
    """First sheet of every workbook, columns found by the titles in row 1."""
    return workbook_columns(read_workbooks(spark, path), schema, rejects)
