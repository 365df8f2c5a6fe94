"""Spreadsheets (.xlsx) as frames.

A workbook is a zip of XML parts. Each file is one task's work: its rows are streamed from the sheet's part, and a cell keeps whether
it is a number or text. A sheet has 1,048,576 rows at most, so a file bounds a task; many files are read side by side.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import materialise, ship_package

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_ROWS = 4096


def _column(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA."""
    at = 0
    for c in re.match("[A-Z]+", reference)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _text(element: ElementTree.Element) -> str:
    """The text of a string item, plain or in runs; phonetic hints don't count."""
    return "".join(t.text or "" for part in element if part.tag != f"{_MAIN}rPh" for t in part.iter(f"{_MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, element in ElementTree.iterparse(part):
            if element.tag == f"{_MAIN}si":
                out.append(_text(element))
                element.clear()
    return out


def _part_of(book: zipfile.ZipFile, sheet: str | int) -> str:
    """Name of the sheet's part, by its name or its place from 0."""
    sheets = [(s.get("name"), s.get(_LINK)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
    found = [link for i, (name, link) in enumerate(sheets) if sheet in (i, name)]
    if not found:
        raise ValueError(f"no sheet {sheet!r}; there are {[n for n, _ in sheets]}")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    return posixpath.normpath(posixpath.join("xl", links[found[0]])) if not links[found[0]].startswith("/") else links[found[0]][1:]


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[str | None], list[bool | None]]]:
    """Number from 1, cells as text and whether each is a number, for the rows of a sheet that hold something.

    Empty cells and errors are None; booleans are the texts TRUE and FALSE.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        with book.open(_part_of(book, sheet)) as part:
            number = 0
            for event, element in ElementTree.iterparse(part, ("start", "end")):
                if event == "start" or element.tag != f"{_MAIN}row":
                    continue
                number = int(element.get("r") or number + 1)
                cells: dict[int, tuple[str, bool]] = {}
                at = -1
                for c in element.iter(f"{_MAIN}c"):
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    kind, value = c.get("t", "n"), c.findtext(f"{_MAIN}v")
                    if kind == "inlineStr":
                        inline = c.find(f"{_MAIN}is")
                        value = None if inline is None else _text(inline)
                    elif kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "b" and value is not None:
                        value = "TRUE" if value == "1" else "FALSE"
                    elif kind == "e":
                        value = None
                    if value:
                        cells[at] = value, kind == "n"
                element.clear()
                if cells:
                    row = [cells.get(i, (None, None)) for i in range(max(cells) + 1)]
                    yield number, [v for v, _ in row], [n for _, n in row]


def read_sheet(spark: SparkSession, path: str | Sequence[str], sheet: str | int = 0, skip: int = 0, text: Sequence[str] = (), source: str | None = None) -> DataFrame:
    """The rows below the header of a sheet, which is its first row after ``skip`` rows; files must share it.

    A column is DOUBLE if all its cells are numbers and it is not named in ``text``, else STRING; empty cells are NULL. A header's
    empty name becomes X1, X2, ... by place. Dates are the numbers that the sheet holds. ``source`` names a column for the file's
    name. The workbooks are parsed once.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content")
    fields = ["path", "at", "cells", "numbers"]
    types = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows = []
                for at, cells, numbers in sheet_rows(content.as_buffer().to_pybytes(), sheet):
                    if at > skip:
                        rows.append((name, at, cells, numbers))
                    if len(rows) == _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)

    # A file is a record of its own size, so few go into one batch.
    parsed = materialise(files.repartition(F.col("path")).mapInArrow(run, "path string, at long, cells array<string>, numbers array<boolean>"))
    heads = parsed.groupBy("path").agg(F.min(F.struct("at", "cells")).alias("head"))
    distinct = [r["cells"] for r in heads.select("head.cells").distinct().limit(2).collect()]
    if len(distinct) != 1:
        raise ValueError("no header found" if not distinct else f"files differ in their headers: {distinct[0]} and {distinct[1]}")
    names = [n.strip() if n and n.strip() else f"X{i + 1}" for i, n in enumerate(distinct[0])]
    body = parsed.join(heads.select("path", F.col("head.at").alias("first")), "path").filter("at > first")
    kinds = body.select(F.posexplode("numbers").alias("place", "number")).filter("number IS NOT NULL").groupBy("place").agg(F.bool_and("number").alias("all"))
    numeric = {r["place"] for r in kinds.filter("all").collect()}
    cell = lambda i: F.get("cells", F.lit(i))
    columns = [(cell(i).cast(T.DoubleType()) if i in numeric and n not in text else cell(i)).alias(n) for i, n in enumerate(names)]
    if source:
        columns.append(F.element_at(F.split("path", "/"), -1).alias(source))
    return body.select(*columns)
