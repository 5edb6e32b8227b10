"""Sheets of XLSX workbooks as tables of strings, parsed in a task with the standard library."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as Tree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.delimited import ROW

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
BATCH = 2000


def part_path(target: str) -> str:
    """A relationship's target as a name in the archive."""
    target = target.replace("\\", "/")
    return posixpath.normpath(target.lstrip("/") if target.startswith(("/", "xl/")) else f"xl/{target}")


def column_index(ref: str) -> int:
    """The column of a cell reference such as ``AB12``, from 0; -1 without letters."""
    n = 0
    for c in ref.upper():
        if not "A" <= c <= "Z":
            break
        n = n * 26 + ord(c) - 64
    return n - 1


def leading_int(text: str) -> int:
    digits = ""
    for c in text:
        if not c.isdigit():
            break
        digits += c
    return int(digits or 0)


def sheet_part(archive: zipfile.ZipFile, name: str = "", index: int = 1) -> str:
    """The part that holds a sheet: by name (case doesn't count), else by its sheetId."""
    book = Tree.fromstring(archive.read("xl/workbook.xml"))
    sheets = [(s.get("name", ""), leading_int(s.get("sheetId", "")), s.get(f"{REL}id")) for s in book.iter(f"{MAIN}sheet")]
    rels = "xl/_rels/workbook.xml.rels"
    targets = {r.get("Id"): part_path(r.get("Target", "")) for r in Tree.fromstring(archive.read(rels)).iter(f"{PACKAGE}Relationship")} if rels in archive.namelist() else {}
    if name:
        found = [s for s in sheets if s[0].lower() == name.lower()]
        if not found:
            raise ValueError(f"no sheet {name!r}; there are: {', '.join(s[0] for s in sheets)}")
    else:
        found = [s for s in sheets if s[1] == index]
    return targets.get(found[0][2], f"xl/worksheets/sheet{found[0][1]}.xml") if found else f"xl/worksheets/sheet{index}.xml"


def sheet_rows(data: bytes, name: str = "", index: int = 1) -> Iterator[list[str]]:
    """The rows of a sheet: cells at their places, gaps empty. Rows that are absent are not given."""
    archive = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in Tree.fromstring(archive.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
    with archive.open(sheet_part(archive, name, index)) as part:
        for _, element in Tree.iterparse(part):
            if element.tag != f"{MAIN}row":
                continue
            row: list[str] = []
            for cell in element.iter(f"{MAIN}c"):
                value = cell.findtext(f"{MAIN}v") or ""
                if cell.get("t") == "s":
                    value = shared[leading_int(value)] if value and leading_int(value) < len(shared) else ""
                elif cell.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                at = column_index(cell.get("r", ""))
                at = len(row) if at < 0 else at
                row += [""] * (at + 1 - len(row))
                row[at] = value
            element.clear()
            yield row


def read_workbook(spark: SparkSession, path: str, sheet: str = "", index: int = 1) -> DataFrame:
    """A sheet as a table of strings with the column ``__row``; its first row is the header. A workbook is
    an archive and is read by one task; only the header comes to the driver."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows: list[list[str]] = []
                at = 0
                for row in sheet_rows(content.as_py(), sheet, index):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["row", "cells"])
                        at, rows = at + len(rows), []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["row", "cells"])

    long = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row long, cells array<string>")
    first = long.where("row = 0").first()
    header = first["cells"] if first else []
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    return long.where("row > 0").select(*(cell(i).alias(name) for i, name in enumerate(header)), F.col("row").alias(ROW))
