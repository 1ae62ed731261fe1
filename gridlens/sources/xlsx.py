"""Spreadsheet cells: load(spark, path) reads every workbook under a path.

Each workbook is read whole by one task, with the standard library alone: the zip's parts as XML, shared and inline
strings, cached values of formulas, number formats that show dates (both epochs), merged regions and sheet order. Rows
are the cells; `kind` tells cells from merges and from the extents of sheets, which count empty cells that the file holds. A broken workbook gives one row of kind `error` and stops no other.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import cached_property
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "workbook_id string, sheet string, sheet_ord int, kind string, r int, c int, r2 int, c2 int, dtype string, sval string, nval double, dval timestamp"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Numbers of the built-in formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _place(ref: str) -> tuple[int, int]:
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", ref.replace("$", "")).groups()
    column = 0
    for x in letters:
        column = column * 26 + ord(x) - 64
    return int(row), column


def _text(node: ET.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _date_styles(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style, whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    own = {int(n.get("numFmtId")): bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "").lower()))) for n in root.iter(f"{_MAIN}numFmt")}
    styles = root.find(f"{_MAIN}cellXfs")
    return [own.get(k, k in DATE_FORMATS) for k in (int(x.get("numFmtId", 0)) for x in (styles if styles is not None else []))]


class Book:
    """A workbook in a file that can be read at any place: only the parts that are asked for are unpacked."""

    def __init__(self, file: BinaryIO):
        self.zip = zipfile.ZipFile(file)
        root = ET.fromstring(self.zip.read("xl/workbook.xml"))
        setting = root.find(f"{_MAIN}workbookPr")
        self.epoch = datetime(1904, 1, 1) if setting is not None and setting.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self._targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        #: (name, relation) of each sheet in order.
        self.sheets = [(s.get("name"), s.get(_REL)) for s in root.iter(f"{_MAIN}sheet")]

    @cached_property
    def shared(self) -> list[str]:
        return [_text(x) for x in ET.fromstring(self.zip.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in self.zip.namelist() else []

    @cached_property
    def dates(self) -> list[bool]:
        return _date_styles(self.zip)

    def rows(self, name: str, order: int, size: int) -> Iterator[tuple]:
        """The rows of one sheet."""
        sheet, relation = self.sheets[order]
        target = self._targets[relation]
        part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        head = (name, sheet, order)
        at_row, low, right = 0, 1, 1
        with self.zip.open(part) as content:
            for _, node in ET.iterparse(content):
                if node.tag == f"{_MAIN}row":
                    at_row = int(node.get("r", at_row + 1))
                    at_column = 0
                    for cell in node.iter(f"{_MAIN}c"):
                        row, at_column = _place(cell.get("r")) if cell.get("r") else (at_row, at_column + 1)
                        low, right = max(low, row), max(right, at_column)
                        value = _value(cell, self.shared, self.dates, self.epoch)
                        if value:
                            yield (*head, "cell", row, at_column, None, None, *value)
                    node.clear()
                elif node.tag == f"{_MAIN}mergeCell":
                    first, _, last = node.get("ref").partition(":")
                    (r1, c1), (r2, c2) = _place(first), _place(last or first)
                    low, right = max(low, r2), max(right, c2)
                    yield (*head, "merge", r1, c1, r2, c2, None, None, None, None)
        yield (*head, "sheet", low, right, None, None, None, None, float(size), None)


def error_row(name: str, error: Exception) -> tuple:
    """The row that stands for a workbook that cannot be read."""
    return (name, None, None, "error", None, None, None, None, None, f"{type(error).__name__}: {error}"[:200], None, None)


def read_workbook(name: str, content: bytes) -> Iterator[tuple]:
    """The rows of one workbook."""
    book = Book(io.BytesIO(content))
    for order in range(len(book.sheets)):
        yield from book.rows(name, order, len(content))


def _value(cell: ET.Element, shared: list[str], dates: list[bool], epoch: datetime) -> tuple | None:
    """(dtype, sval, nval, dval), or nothing for an empty cell."""
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "str", _text(cell.find(f"{_MAIN}is")), None, None
    node = cell.find(f"{_MAIN}v")
    if node is None or node.text is None:
        return None
    text = node.text
    if kind == "s":
        return "str", shared[int(text)], None, None
    if kind == "b":
        return "bool", "True" if text == "1" else "False", float(text), None
    if kind == "e":
        return "error", text, None, None
    if kind == "str":
        return "str", text, None, None
    if kind == "d":
        day = datetime.fromisoformat(text.removesuffix("Z"))
        return "date", str(day), None, day
    number, style = float(text), int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        day = epoch + timedelta(seconds=round(number * 86400))
        return "date", str(day), None, day
    if number.is_integer() and "." not in text and "e" not in text.lower():
        return "int", str(int(number)), number, None
    return "float", repr(number), number, None


def parse(files: DataFrame) -> DataFrame:
    """All rows of workbooks (path, content); each is read where it lies, by one task."""
    import pandas as pd

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out = list(read_workbook(name, content))
                except Exception as error:  # noqa: BLE001  one broken file must not stop the others
                    out = [error_row(name, error)]
                frame = pd.DataFrame(out, columns=names)
                for column in ("sheet_ord", "r", "c", "r2", "c2"):
                    frame[column] = frame[column].astype("Int32")
                frame["dval"] = pd.to_datetime(frame["dval"])
                yield frame

    return files.select("path", "content").mapInPandas(rows, SCHEMA)


def load(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all workbooks under a path that Spark can list."""
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path))


def cells(rows: DataFrame) -> DataFrame:
    """The cells in the form that the operators read."""
    return rows.where("kind = 'cell'").select("workbook_id", "sheet", "r", "c", "dtype", "sval", "nval", "dval")


def merges(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'merge'").select("workbook_id", "sheet", F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("r2"), F.col("c2"))


def extents(rows: DataFrame) -> DataFrame:
    """(sheet_ord, max_row, max_col) of each sheet."""
    return rows.where("kind = 'sheet'").select("workbook_id", "sheet", "sheet_ord", F.col("r").alias("max_row"), F.col("c").alias("max_col"))


def errors(rows: DataFrame) -> DataFrame:
    """(workbook_id, error) of workbooks that could not be read."""
    return rows.where("kind = 'error'").select("workbook_id", F.col("sval").alias("error"))


def summaries(rows: DataFrame) -> DataFrame:
    """(sheet_count, sheets, size_kb): the sheets of each workbook in order, and its size in whole kilobytes."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sheet_ord", "sheet"))), lambda x: x["sheet"])
    return rows.where("kind = 'sheet'").groupBy("workbook_id").agg(F.count(F.lit(1)).alias("sheet_count"), listed.alias("sheets"), F.floor(F.max("nval") / 1024).cast("long").alias("size_kb"))


def stem(workbook_id: Column) -> Column:
    """The name of a workbook's file without its ending."""
    name = F.url_decode(F.replace(F.element_at(F.split(workbook_id, "/"), -1), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
