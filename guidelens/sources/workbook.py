"""Workbooks (xlsx): sheets as rows of cells, read by tasks and written by tasks into one file.

A workbook is zipped XML. Reading goes through Spark's binaryFile reader, so any file
system will do, a file a task; rows stream out of each sheet's XML, and shared strings are
read once a file. Writing makes the XML of blocks of rows in tasks; the driver
opens the one file that a workbook is, and streams the blocks into it as they come, in
order, so it holds one block at a time; the file is in place only when it is whole.

Cells are text or numbers. Missing cells inside a row are empty text, and rows without
cells are left out. Control characters, which XML has no place for, are escaped as
spreadsheets do. A sheet's rows, a row's cells and a cell's text are limited by the
format, and more of them are an error, never cut.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "file string, ordinal int, sheet string, hidden boolean, row int, cells array<string>"
SHEET_ROWS = "ordinal int, sheet string, hidden boolean, row int, cells array<struct<text:string,number:double>>"
#: Fixed values of the format.
MOST_ROWS, MOST_COLUMNS, MOST_TEXT = 1_048_576, 16_384, 32_767
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]|_x(?=[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
BLOCK = 1000  # rows


def column_of(name: str) -> int:
    """0-based column of a cell's name (AB12)."""
    out = 0
    for c in name:
        if not c.isalpha():
            break
        out = out * 26 + ord(c.upper()) - 64
    return out - 1


def column_name(at: int) -> str:
    out, at = "", at + 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out


def _text(node) -> str:
    """All text of a string item, runs joined, phonetic hints left out."""
    parts = [t.text or "" for child in node if child.tag != f"{_MAIN}rPh" for t in ([child] if child.tag == f"{_MAIN}t" else child.iter(f"{_MAIN}t"))]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _rows(book: zipfile.ZipFile, name: str, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
    number = 0
    with book.open(name) as f:
        for _, node in ElementTree.iterparse(f):
            if node.tag != f"{_MAIN}row":
                continue
            number = int(node.get("r", number + 1))
            cells: list[str] = []
            for cell in node.iter(f"{_MAIN}c"):
                at = column_of(cell.get("r", "")) if cell.get("r") else len(cells)
                kind, value = cell.get("t", "n"), cell.findtext(f"{_MAIN}v") or ""
                inline = cell.find(f"{_MAIN}is")
                if kind == "s":
                    value = shared[int(value)]
                elif inline is not None:
                    value = _text(inline)
                elif kind == "b":
                    value = "TRUE" if value == "1" else "FALSE"
                elif kind == "str":
                    value = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), value)
                cells += [""] * (at - len(cells)) + [value]
            node.clear()
            if any(cells):
                yield number, cells


def sheets_of(content: bytes) -> Iterator[tuple[int, str, bool, int, list[str]]]:
    """(ordinal, sheet, hidden, row, cells) of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for _, node in ElementTree.iterparse(f):
                    if node.tag == f"{_MAIN}si":
                        shared.append(_text(node))
                        node.clear()
        for ordinal, sheet in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")):
            target = links[sheet.get(_LINK)]
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for row, cells in _rows(book, name, shared):
                yield ordinal, sheet.get("name"), sheet.get("state", "visible") != "visible", row, cells


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of all sheets of workbooks, as CELLS has them; file is the last part of a path."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, content in zip(part.column("path"), part.column("content"), strict=True):
                rows: list[tuple] = []
                for found in sheets_of(content.as_py()):
                    rows.append((path.as_py().rsplit("/", 1)[-1], *found))
                    if len(rows) == BLOCK:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "ordinal", "sheet", "hidden", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, CELLS)


def _escaped(text: str) -> str:
    return escape(_CONTROL.sub(lambda m: f"_x{ord(m[0][0]):04X}_" + m[0][1:], text))


def row_xml(row: int, cells: list[dict]) -> str:
    if not 1 <= row <= MOST_ROWS or len(cells) > MOST_COLUMNS:
        raise ValueError(f"row {row} of {len(cells)} cells: a sheet has {MOST_ROWS} rows of {MOST_COLUMNS} cells at most")
    out = []
    for at, cell in enumerate(cells):
        place = f'r="{column_name(at)}{row}"'
        if cell and cell["number"] is not None:
            out.append(f"<c {place}><v>{cell['number']!r}</v></c>")
        elif cell and cell["text"]:
            if len(cell["text"]) > MOST_TEXT:
                raise ValueError(f"a text of {len(cell['text'])} characters: a cell has {MOST_TEXT} at most")
            out.append(f'<c {place} t="inlineStr"><is><t xml:space="preserve">{_escaped(cell["text"])}</t></is></c>')
    return f'<row r="{row}">{"".join(out)}</row>'


class _Stream:
    """A Hadoop output stream for zipfile, which needs no seeking."""

    def __init__(self, out) -> None:
        self.out, self.at = out, 0

    def write(self, data: bytes) -> int:
        self.out.write(bytearray(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        self.out.flush()


def write(rows: DataFrame, path: str) -> None:
    """rows (as SHEET_ROWS has them; ordinal orders the sheets) as one workbook; the tasks make the XML, and the file appears when it is whole."""
    spark = rows.sparkSession

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = []
            for low in range(0, part.num_rows, BLOCK):
                some = part.slice(low, BLOCK).to_pylist()
                at = 0
                while at < len(some):  # a block holds rows of one sheet
                    stop = at
                    while stop < len(some) and some[stop]["ordinal"] == some[at]["ordinal"]:
                        stop += 1
                    found.append((some[at]["ordinal"], some[at]["sheet"], some[at]["hidden"], some[at]["row"], "".join(row_xml(r["row"], r["cells"]) for r in some[at:stop])))
                    at = stop
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), [pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string()], strict=True)], ["ordinal", "sheet", "hidden", "row", "xml"])

    blocks = rows.select("ordinal", "sheet", "hidden", "row", "cells").repartitionByRange("ordinal", "row").sortWithinPartitions("ordinal", "row").mapInArrow(run, "ordinal int, sheet string, hidden boolean, row int, xml string")
    jvm = spark._jvm
    at, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".draft")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, True)
    sheets: list[tuple[str, bool]] = []
    with zipfile.ZipFile(_Stream(out), "w", zipfile.ZIP_DEFLATED) as book:
        part, now = None, None
        for block in blocks.orderBy("ordinal", "row").toLocalIterator():
            if block.ordinal != now:
                if part:
                    part.write(b"</sheetData></worksheet>")
                    part.close()
                now = block.ordinal
                sheets.append((block.sheet, block.hidden))
                part = book.open(f"xl/worksheets/sheet{len(sheets)}.xml", "w", force_zip64=True)
                part.write(f'{_HEAD}<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
            part.write(block.xml.encode("utf-8", "replace"))
        if part:
            part.write(b"</sheetData></worksheet>")
            part.close()
        for name, text in frame(sheets).items():
            book.writestr(name, _HEAD + text)
    out.close()
    files.delete(at, False)
    if not files.rename(draft, at):
        raise OSError(f"{path} can't be put in place")


def frame(sheets: list[tuple[str, bool]]) -> dict[str, str]:
    """The parts of a workbook that name its sheets."""
    if len({n.lower() for n, _ in sheets}) < len(sheets) or any(not 1 <= len(n) <= 31 or set(n) & set("[]:*?/\\") for n, _ in sheets):
        raise ValueError("sheets need distinct names of 1 to 31 characters without []:*?/\\")
    base = "http://schemas.openxmlformats.org"
    numbers = range(1, len(sheets) + 1)
    return {
        "[Content_Types].xml": f'<Types xmlns="{base}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in numbers)
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{base}/package/2006/relationships"><Relationship Id="rId1" Type="{base}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{base}/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}"{" state=" + quoteattr("hidden") if h else ""} r:id="rId{i}"/>' for i, (n, h) in zip(numbers, sheets, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{base}/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{base}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>",
    }


def cell(value) -> F.Column:
    """A text or number column as a cell."""
    column = value if isinstance(value, F.Column) else F.lit(value)
    return F.struct(column.cast("string").alias("text"), F.lit(None).cast("double").alias("number"))


def number(value) -> F.Column:
    column = value if isinstance(value, F.Column) else F.lit(value)
    return F.struct(F.lit(None).cast("string").alias("text"), column.cast("double").alias("number"))
