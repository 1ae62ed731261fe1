"""Workbooks as a data source: spark.read.format("xlsx_cells").load(path), and spark.readStream alike.

One partition is one sheet of one workbook. The driver reads of each file its table of contents and the list of sheets; a
task unpacks its own sheet, the shared strings and the styles, and nothing else. Equality and IN filters on workbook_id,
sheet, sheet_ord and kind are pushed down: sheets that cannot match are no partitions and are never parsed. Columns are typed
as in `xlsx.SCHEMA`, with nulls where a cell has no number or date. A workbook that cannot be read is one row of kind error.

Paths are those that Arrow's file systems open (local, HDFS, S3, GCS); `xlsx.load` reads what only Spark can list. Filter
pushdown needs spark.sql.python.filterPushdown.enabled; without it the rows are the same, and all sheets are parsed.

As a stream, each file is read once, in order of change; a file must be complete when it appears, and must not carry a time
of change before that of files already read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote
from zipfile import BadZipFile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from gridlens.sources import xlsx

FORMAT = "xlsx_cells"
_PUSHED = ("workbook_id", "sheet", "sheet_ord", "kind")


def _opened(path: str):
    """(Arrow's file system, path within it, what stands before paths in names)."""
    from pyarrow import fs

    uri = path[5:] if path.startswith("file:") else path
    system, root = fs.FileSystem.from_uri(uri)
    local = isinstance(system, fs.LocalFileSystem)
    return system, unquote(root) if path.startswith("file:") else root, "file:" if local else path.split("://")[0] + "://"


def _book(content) -> xlsx.Book:
    """The workbook in an Arrow file, which says in its own way that a place lies outside it."""
    from pyarrow import ArrowInvalid

    try:
        return xlsx.Book(content)
    except ArrowInvalid as error:
        raise BadZipFile("File is not a zip file") from error


@dataclass(frozen=True, order=True)
class Found:
    """A file by its time of change, its path and its size."""

    changed: int
    path: str
    size: int


def listed(path: str) -> list[Found]:
    """The workbooks at a path, a file or a folder and all below it, in order of change."""
    from pyarrow import fs

    system, root, _ = _opened(path)
    info = system.get_file_info(root)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted(Found(i.mtime_ns or 0, i.path, i.size or 0) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(".xlsx"))


@dataclass
class Sheet(InputPartition):
    """One sheet of one workbook, or the error of a workbook without a readable list of sheets."""

    path: str
    name: str
    size: int
    order: int | None
    error: tuple | None = None


class _Sheets:
    """Lists and reads sheets for both readers."""

    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set] = {}

    def good(self, **known: object) -> bool:
        return all(k not in known or known[k] in v for k, v in self.wanted.items())

    def of(self, files: Iterable[Found]) -> list[Sheet]:
        system, _, scheme = _opened(self.path)
        out = []
        for file in files:
            name = scheme + file.path
            if not self.good(workbook_id=name):
                continue
            try:
                with system.open_input_file(file.path) as content:
                    sheets = _book(content).sheets
            except Exception as error:  # noqa: BLE001  one broken file must not stop the others
                out.append(Sheet(file.path, name, file.size, None, xlsx.error_row(name, error)))
                continue
            out += [Sheet(file.path, name, file.size, k) for k, (sheet, _) in enumerate(sheets) if self.good(sheet=sheet, sheet_ord=k)]
        return out

    def read(self, sheet: Sheet | None) -> Iterator[tuple]:
        """The rows of a partition; without partitions Spark asks for one that is None."""
        if sheet is None:
            return
        if sheet.order is None:
            yield sheet.error
            return
        system = _opened(self.path)[0]
        try:
            with system.open_input_file(sheet.path) as content:
                rows = [r for r in _book(content).rows(sheet.name, sheet.order, sheet.size) if self.good(kind=r[3])]
        except Exception as error:  # noqa: BLE001
            rows = [xlsx.error_row(sheet.name, error)]
        yield from rows


class CellReader(DataSourceReader):
    """The cells, regions and extents of workbooks at rest."""

    def __init__(self, path: str):
        self.sheets = _Sheets(path)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in _PUSHED:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.sheets.wanted[name] = self.sheets.wanted.get(name, values) & values
            if name in ("sheet", "sheet_ord", "kind"):
                yield f  # rows of errors have no sheet; Spark drops them as it would without pushdown

    def partitions(self) -> list[Sheet]:
        return self.sheets.of(listed(self.sheets.path))

    def read(self, partition: Sheet | None) -> Iterator[tuple]:
        return self.sheets.read(partition)


class CellStream(DataSourceStreamReader):
    """Workbooks as they arrive. An offset is the last file read: its time of change and its path."""

    def __init__(self, path: str):
        self.sheets = _Sheets(path)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.sheets.path)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Sheet]:
        key = lambda o: (o["changed"], o["path"])
        return self.sheets.of(f for f in listed(self.sheets.path) if key(start) < (f.changed, f.path) <= key(end))

    def read(self, partition: Sheet | None) -> Iterator[tuple]:
        return self.sheets.read(partition)

    def commit(self, end: dict) -> None:
        pass


class XlsxCells(DataSource):
    """The format "xlsx_cells"."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return xlsx.SCHEMA

    def reader(self, schema) -> CellReader:
        return CellReader(self.options["path"])

    def streamReader(self, schema) -> CellStream:
        return CellStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and turns its filter pushdown on."""
    spark.dataSource.register(XlsxCells)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
