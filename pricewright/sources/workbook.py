"""Workbooks as a data source: ``spark.read.format("workbook").load(folder)``.

Sheets come in the order in which the workbook lists them, each read by a task of its
own, as a stream of rows.  The file is opened where it is and read in ranges, so neither
a file nor a sheet is held whole; the texts that cells share are, for a sheet's task.
The first sheet is read, or all with the option ``sheets`` "all".  Rows are maps from
the names in a sheet's first row that holds a cell.  Workbooks of the old binary kind
(``.xls``) are refused.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pricewright.sources.stores import located, opened

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
SCHEMA = "path string, sheet string, line long, row map<string,string>"


class Sheet(InputPartition):
    def __init__(self, path: str, name: str, part: str):
        self.path, self.name, self.part = path, name, part


def files(folder: str) -> list[str]:
    """All workbooks below a folder, or the one named; by path."""
    store, at = located(folder)
    info = store.get_file_info(at)
    found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(at, recursive=True))
    names = sorted(x.path for x in found if x.is_file and re.search(r"(?i)\.xlsx?$", x.path))
    old = [x for x in names if x.lower().endswith(".xls")]
    if old:
        raise ValueError(f"{old[0]} is a binary .xls workbook, which cannot be read; save it as .xlsx")
    scheme = "" if isinstance(store, pafs.LocalFileSystem) else re.match(r"^[^:]+:(//[^/]*)?", folder)[0]
    return [f"{scheme}{x}" for x in names]


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the sheets in the workbook's order; by number where it does not list them."""
    parts = {n for n in book.namelist() if n.startswith("xl/worksheets/")}
    if not {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
        numbered = [n for n in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        return [(n.rpartition("/")[2][:-4], n) for n in sorted(numbered, key=lambda n: int(re.search(r"\d+", n)[0]))]
    target = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    listed = [(x.get("name"), target.get(x.get(_RELATION), "")) for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    whole = [(name, part.lstrip("/") if part.startswith("/") else f"xl/{part}") for name, part in listed]
    return [(name, part) for name, part in whole if part in parts]


def _texts(element: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in element.iter(f"{_MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    found = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, x in ElementTree.iterparse(f):
            if x.tag == f"{_MAIN}si":
                found.append(_texts(x))
                x.clear()
    return found


def rows_of(book: zipfile.ZipFile, part: str) -> Iterator[dict[str, str]]:
    """The rows of a sheet under the names of its first row, one element at a time."""
    shared, header = _shared(book), {}
    with book.open(part) as f:
        parents: list[ElementTree.Element] = []
        for event, x in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                parents.append(x)
                continue
            parents.pop()
            if x.tag != f"{_MAIN}row":
                continue
            cells = {}
            for k, c in enumerate(x.iter(f"{_MAIN}c")):
                value = c.find(f"{_MAIN}v")
                text = _texts(c) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                place = re.match("[A-Z]+", c.get("r", ""))
                cells[place[0] if place else str(k)] = shared[int(text)] if c.get("t") == "s" else text
            if parents:
                parents[-1].clear()  # what was read of the sheet's data
            if not header:
                header = cells
            elif cells:
                yield {name: cells[k] for k, name in header.items() if k in cells}


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.all = options["path"], options.get("sheets", "first") == "all"

    def partitions(self) -> list[Sheet]:
        found = []
        for path in files(self.path):
            with opened(path) as f, zipfile.ZipFile(f) as book:
                listed = sheets(book)
            found += [Sheet(path, name, part) for name, part in (listed if self.all else listed[:1])]
        return found

    def read(self, partition: Sheet) -> Iterator[tuple]:
        with opened(partition.path) as f, zipfile.ZipFile(f) as book:
            for line, row in enumerate(rows_of(book, partition.part)):
                yield (partition.path, partition.name, line, row)


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbook)
