"""A Python data source for spreadsheet grids: one row per sheet row, from csv or xlsx files, a partition per file.

    spark.dataSource.register(SheetSource)
    spark.read.format("sheet").load("/lists/*.xlsx")

Options: path (a file, a folder or a pattern), sheet (name; the first by default), delimiter (csv; told from the text
by default). Rows: path, sheet, source_row (physical, from 1), cells (strings; NULL for empty ones).
"""

from __future__ import annotations

import csv
import glob
import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, sheet string, source_row int, cells array<string>"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DELIMITERS = ",;\t|"
ENCODINGS = ("utf-8-sig", "cp1252")


def decode(raw: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def sniff_delimiter(text: str) -> str:
    """The delimiter that splits the first lines into the most columns, evenly; one column only is an error."""
    lines = [line for line in text.splitlines()[:20] if line.strip()]
    scores = {d: (min((line.count(d) for line in lines), default=0), sum(line.count(d) for line in lines)) for d in DELIMITERS}
    best = max(scores, key=lambda d: scores[d])
    if not scores[best][1]:
        raise ValueError("no delimiter splits the file into columns")
    return best


def csv_rows(raw: bytes, delimiter: str | None = None) -> Iterator[tuple[int, list[str | None]]]:
    """(physical line on which the record starts, cells)."""
    text = decode(raw)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter or sniff_delimiter(text))
    start = 1
    for record in reader:
        if record:
            yield start, [c if c.strip() else None for c in record]
        start = reader.line_num + 1


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def xlsx_rows(raw: bytes, sheet: str | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of one sheet; values only. Rows are streamed from the archive."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = book.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        sheets = [(s.get("name"), targets[s.get(_REL)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        chosen = next((s for s in sheets if sheet in (None, s[0])), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet!r}; there are {[s[0] for s in sheets]}")
        target = chosen[1].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            number = 0
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list[str | None] = []
                for c in row.iter(f"{_NS}c"):
                    at = _column(c.get("r")) if c.get("r") else len(cells) + 1
                    cells += [None] * (at - len(cells))
                    value = c.find(f"{_NS}v")
                    text = None if value is None else value.text
                    if c.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    elif c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif c.get("t") == "b":
                        text = {"1": "true", "0": "false"}.get(text, text)
                    cells[at - 1] = text if text and text.strip() else None
                yield chosen[0], number, cells
                row.clear()


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        path = self.options.get("path", "")
        path = path.removeprefix("file://")
        found = sorted(os.path.join(path, n) for n in os.listdir(path)) if os.path.isdir(path) else sorted(glob.glob(path))
        files = [f for f in found if f.lower().endswith((".csv", ".xlsx"))] if os.path.isdir(path) else found
        if not files:
            raise ValueError(f"no file matches {path!r}")
        return [_File(f) for f in files]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            raw = f.read()
        if raw[:4] == b"PK\x03\x04":
            for sheet, number, cells in xlsx_rows(raw, self.options.get("sheet")):
                yield partition.path, sheet, number, cells
        elif raw[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
            raise ValueError(f"{partition.path}: the older binary workbook format is not read")
        else:
            for number, cells in csv_rows(raw, self.options.get("delimiter")):
                yield partition.path, None, number, cells


class SheetSource(DataSource):
    @classmethod
    def name(cls):
        return "sheet"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
