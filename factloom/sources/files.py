"""Files to lines and cells. Input is a frame ``(path, content)`` as ``spark.read.format('binaryFile')`` gives it.

A file that cannot be read is a row with an error code, never a failed job. Spark spreads the files over tasks; the
helpers decode one file at a time with the standard library.
"""

from __future__ import annotations

import csv
import datetime
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.blocks import normalise_text

CELLS = ("path string, error string, table_ord int, title string, section string, row_ord int, line_no int, col_ord int, "
         "header string, raw string, malformed int")
# Bounds of one workbook or document archive.
MAX_PARTS, MAX_BYTES, MAX_SHEETS, MAX_ROWS, MAX_COLS = 200, 50_000_000, 20, 10_000, 200
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_BUILTIN_DATES = {14, 15, 16, 17, 22}


class Unreadable(Exception):
    """Carries the error code of a file."""


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_text(files: DataFrame) -> DataFrame:
    """UTF-8 text (byte order mark allowed), normalised; wrong encoding or emptiness is an error. All in the JVM."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    clean = normalise_text(F.regexp_replace(text, "^\\x{FEFF}", ""))
    t = files.select("path", text.isNotNull().alias("_ok"), clean.alias("text"))
    return t.select("path", F.when(F.col("_ok"), F.nullif(F.col("text"), F.lit(""))).alias("text"),
                    F.when(~F.col("_ok"), "invalid_encoding").when(F.col("text") == "", "no_text").alias("error"))


class _Table:
    """Cells of one table on their way out: a header of two or more, rows of that width, the others counted."""

    def __init__(self, ordinal: int, title: str | None, section: str | None):
        self.ordinal, self.title, self.section = ordinal, title, section
        self.header: list[str] | None = None
        self.rows: list[tuple[int, list[str]]] = []
        self.malformed = 0

    def add(self, line: int, cells: list[str]) -> None:
        if self.header is None:
            self.header = cells
        elif len(cells) == len(self.header):
            self.rows.append((line, cells))
        else:
            self.malformed += 1

    def cells_into(self, columns: list[list], path: str) -> None:
        """Appends the cells to ``columns``, one list for each column of ``CELLS``."""
        width, rows = len(self.header or ()), len(self.rows)
        many = width * rows
        paths, errors, ordinals, titles, sections, row_ords, lines, col_ords, headers, raws, malformed = columns
        for r, (line, values) in enumerate(self.rows, start=1):
            row_ords += [r] * width
            lines += [line] * width
            raws += values
        paths += [path] * many
        errors += [None] * many
        ordinals += [self.ordinal] * many
        titles += [self.title] * many
        sections += [self.section] * many
        col_ords += [*range(1, width + 1)] * rows
        headers += (self.header or []) * rows
        malformed += [self.malformed] * many


def _flat(value: str) -> str:
    if value.isalnum():
        return value
    return " ".join(value.replace("\x00", "").split())


def _decode(content: bytes) -> str:
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError as exc:
        raise Unreadable("invalid_encoding") from exc


def csv_tables(content: bytes) -> list[_Table]:
    try:
        records = [[_flat(c) for c in r] for r in csv.reader(io.StringIO(_decode(content), newline=""), strict=True)]
    except csv.Error as exc:
        raise Unreadable("invalid_csv") from exc
    records = [r for r in records if any(r)]
    if len(records) < 2 or len(records[0]) < 2:
        raise Unreadable("no_text" if not records else "invalid_csv")
    table = _Table(1, None, None)
    for line, record in enumerate(records, start=1):
        table.add(line, record)
    return [table]


def _archive(content: bytes, code: str) -> zipfile.ZipFile:
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as exc:
        raise Unreadable(code) from exc
    infos = z.infolist()
    if len(infos) > MAX_PARTS or sum(i.file_size for i in infos) > MAX_BYTES:
        raise Unreadable("docx_archive_too_large" if code == "invalid_docx" else code)
    return z


def _xml(z: zipfile.ZipFile, name: str, code: str) -> ElementTree.Element | None:
    if name not in z.namelist():
        return None
    data = z.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise Unreadable(code)
    try:
        return ElementTree.fromstring(data)
    except ElementTree.ParseError as exc:
        raise Unreadable(code) from exc


def docx_tables(content: bytes) -> list[_Table]:
    root = _xml(_archive(content, "invalid_docx"), "word/document.xml", "invalid_docx")
    body = None if root is None else root.find(f"{_W}body")
    if body is None:
        raise Unreadable("invalid_docx")
    words = lambda e: _flat("".join(t.text or "" for t in e.iter(f"{_W}t")))
    tables, section, before, line = [], None, None, 0
    for part in body:
        if part.tag == f"{_W}p":
            said = words(part)
            style = part.find(f"{_W}pPr/{_W}pStyle")
            if said:
                line += 1
                before = said
                if style is not None and (style.get(f"{_W}val") or "").lower().startswith("heading"):
                    section = said
        elif part.tag == f"{_W}tbl":
            table = _Table(len(tables) + 1, before, section)
            for row in part.iter(f"{_W}tr"):
                cells = [words(c) for c in row.findall(f"{_W}tc")]
                if any(cells):
                    line += 1
                    table.add(line, cells)
            if table.header and len(table.header) >= 2:
                tables.append(table)
    return tables


def _number_text(value: float) -> str:
    return str(int(value)) if value == int(value) else repr(value)


def _xlsx_styles(z: zipfile.ZipFile) -> list[str]:
    """What each cell style shows: ``date``, ``money``, ``percent`` or nothing."""
    root = _xml(z, "xl/styles.xml", "invalid_xlsx")
    if root is None:
        return []
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_S}numFmt")}
    shows = []
    for xf in root.findall(f"{_S}cellXfs/{_S}xf"):
        number = int(xf.get("numFmtId", "0"))
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(number, ""))
        if number in _BUILTIN_DATES or re.search(r"[ymd]", code, re.I):
            shows.append("date")
        elif "%" in code or number in (9, 10):
            shows.append("percent")
        elif "$" in custom.get(number, "") or number in (5, 6, 7, 8, 44):
            shows.append("money")
        else:
            shows.append("")
    return shows


def _xlsx_value(cell: ElementTree.Element, shared: list[str], shows: list[str], epoch: datetime.date) -> str:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return _flat("".join(t.text or "" for t in cell.iter(f"{_S}t")))
    v = cell.find(f"{_S}v")
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "true" if v.text == "1" else "false"
    if kind != "n":
        return _flat(v.text)
    number = float(v.text)
    style = int(cell.get("s", "0"))
    show = shows[style] if style < len(shows) else ""
    if show == "date":
        return (epoch + datetime.timedelta(days=int(number))).isoformat()
    if show == "percent":
        return f"{_number_text(round(number * 100, 10))}%"
    return f"${_number_text(number)}" if show == "money" else _number_text(number)


def xlsx_tables(content: bytes) -> list[_Table]:
    z = _archive(content, "invalid_xlsx")
    book = _xml(z, "xl/workbook.xml", "invalid_xlsx")
    links = _xml(z, "xl/_rels/workbook.xml.rels", "invalid_xlsx")
    if book is None or links is None:
        raise Unreadable("invalid_xlsx")
    targets = {r.get("Id"): r.get("Target") for r in links}
    pr = book.find(f"{_S}workbookPr")
    mac = pr is not None and pr.get("date1904") in ("1", "true")
    epoch = datetime.date(1904, 1, 1) if mac else datetime.date(1899, 12, 30)
    strings = _xml(z, "xl/sharedStrings.xml", "invalid_xlsx")
    shared = [] if strings is None else [_flat("".join(t.text or "" for t in si.iter(f"{_S}t"))) for si in strings.findall(f"{_S}si")]
    shows = _xlsx_styles(z)
    sheets = book.findall(f"{_S}sheets/{_S}sheet")
    if len(sheets) > MAX_SHEETS:
        raise Unreadable("invalid_xlsx")
    tables = []
    for sheet in sheets:
        target = (targets.get(sheet.get(f"{_R}id")) or "").lstrip("/")
        root = _xml(z, target if target.startswith("xl/") else f"xl/{target}", "invalid_xlsx")
        if root is None:
            raise Unreadable("invalid_xlsx")
        table, before, rows = None, None, root.findall(f"{_S}sheetData/{_S}row")
        if len(rows) > MAX_ROWS:
            raise Unreadable("invalid_xlsx")
        for line, row in enumerate(rows, start=1):
            cells: list[str] = []
            for cell in row.findall(f"{_S}c"):
                at = 0
                for letter in re.match(r"[A-Z]*", cell.get("r", "")).group(0):
                    at = at * 26 + ord(letter) - 64
                while at and len(cells) < at - 1:
                    cells.append("")
                cells.append(_xlsx_value(cell, shared, shows, epoch))
            while cells and not cells[-1]:
                cells.pop()
            if len(cells) > MAX_COLS:
                raise Unreadable("invalid_xlsx")
            filled = sum(bool(c) for c in cells)
            if table is None and filled >= 2:
                table = _Table(len(tables) + 1, before, sheet.get("name"))
            if table is not None and filled:
                table.add(line, cells)
            elif filled:
                before = before or cells[0]
        if table is not None:
            tables.append(table)
    return tables


def _parse(files: DataFrame, reader: Callable[[bytes], list[_Table]]) -> DataFrame:
    schema = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in map(str.split, CELLS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in schema]

            def failed(path: str, code: str, malformed: int | None) -> None:
                for column, value in zip(columns, (path, code, *[None] * 8, malformed), strict=True):
                    column.append(value)

            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    tables = reader(content)
                    for table in tables:
                        table.cells_into(columns, path)
                    if not any(t.rows for t in tables):
                        failed(path, "no_rows", sum(t.malformed for t in tables))
                except Unreadable as exc:
                    failed(path, str(exc), None)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, CELLS)


def parse_csv_tables(files: DataFrame) -> DataFrame:
    """Strict comma CSV to cells; ragged rows are counted and left out; line numbers are those after blank lines go."""
    return _parse(files, csv_tables)


def parse_docx_tables(files: DataFrame) -> DataFrame:
    """Tables of a document with heading and preceding paragraph as context."""
    return _parse(files, docx_tables)


def parse_xlsx_tables(files: DataFrame) -> DataFrame:
    """One table per sheet, dates, money and percent shown as text."""
    return _parse(files, xlsx_tables)
