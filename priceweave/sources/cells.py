"""Cells of workbooks with what lies behind their values: formula, kind of the value kept with it, and bold print.

A cell that takes part in a shared formula has the formula as it reads there: references move with the cell, unless a
dollar sign holds them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .files import binary_files
from .sheets import _NS, _REL, _column

SCHEMA = "path string, sheet string, row int, col int, value string, kind string, formula string, bold boolean, error string"
#: Rows of a batch that a task gives back.
BATCH = 5000
#: fixed values: kinds of values by the letters that cells have
KINDS = {"n": "number", "b": "boolean", "e": "error", "s": "text", "str": "text", "inlineStr": "text", "d": "date"}
_REFERENCE = re.compile(r"""("[^"]*"|'[^']*'!?)|(?<![A-Za-z0-9_.])(\$?)([A-Z]{1,3})(\$?)([1-9][0-9]*)(?![A-Za-z0-9_(.])""")


def _letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def moved(formula: str, rows: int, cols: int) -> str:
    """The formula so many rows and columns further on; what leaves the sheet is an error."""

    def one(m: re.Match) -> str:
        if m[1]:
            return m[1]  # a text or the name of a sheet
        col = _column(m[3]) + (0 if m[2] else cols)
        row = int(m[5]) + (0 if m[4] else rows)
        return f"{m[2]}{_letters(col)}{m[4]}{row}" if col > 0 and row > 0 else "#REF!"

    return _REFERENCE.sub(one, formula)


def _bold(book: zipfile.ZipFile) -> list[bool]:
    """For each style of a cell, whether its font is bold."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    fonts = []
    for font in root.iterfind(f"{_NS}fonts/{_NS}font"):
        b = font.find(f"{_NS}b")
        fonts.append(b is not None and b.get("val", "1") not in ("0", "false"))
    return [int(x.get("fontId", 0)) < len(fonts) and fonts[int(x.get("fontId", 0))] for x in root.iterfind(f"{_NS}cellXfs/{_NS}xf")]


def workbook_cells(raw: bytes) -> Iterator[tuple]:
    """(sheet, row, col, value, kind, formula, bold) of the cells of all sheets that hold a value or a formula."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        shared_texts = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared_texts = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        bold = _bold(book)
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = targets[sheet.get(_REL)].lstrip("/")
            masters: dict[str, tuple[str, int, int]] = {}
            number = 0
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_NS}row":
                        continue
                    number, col = int(row.get("r") or number + 1), 0
                    for c in row.iter(f"{_NS}c"):
                        col = _column(c.get("r")) if c.get("r") else col + 1
                        kind, style = c.get("t", "n"), int(c.get("s", 0))
                        v, fx = c.find(f"{_NS}v"), c.find(f"{_NS}f")
                        value = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else None if v is None else v.text
                        if kind == "s" and value is not None:
                            value = shared_texts[int(value)]
                        formula = None
                        if fx is not None:
                            formula = fx.text or None
                            if fx.get("t") == "shared" and formula:
                                masters[fx.get("si")] = (formula, number, col)
                            elif fx.get("t") == "shared" and fx.get("si") in masters:
                                first, at_row, at_col = masters[fx.get("si")]
                                formula = moved(first, number - at_row, col - at_col)
                        if value is not None or formula is not None:
                            yield sheet.get("name"), number, col, value, KINDS.get(kind, "text") if value is not None else None, formula, style < len(bold) and bold[style]
                    row.clear()


def cells(spark: SparkSession, path: str) -> DataFrame:
    """SCHEMA of all workbooks under path; one that cannot be read is a row with its error only."""
    names = [f.strip().split()[0] for f in SCHEMA.split(",")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch["path"].to_pylist(), batch["content"]):
                try:
                    found = [(file, *c, None) for c in workbook_cells(raw.as_py())]
                except Exception as e:  # any content is possible, and each has its row
                    found = [(file, *[None] * 7, f"{type(e).__name__}: {e}")]
                for s in range(0, len(found), BATCH):
                    yield batch_of(found[s : s + BATCH])

    files = binary_files(spark, path, glob="*.xlsx").select("path", "content")
    return table(files.mapInArrow(parse, SCHEMA))


def formula_kinds(found: DataFrame) -> DataFrame:
    """path, sheet, col, kind, n: of the cells that are formulas, how many keep a value of each kind (none: without one)."""
    return found.where("formula is not null").groupBy("path", "sheet", "col", F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def bold_rows(found: DataFrame) -> DataFrame:
    """path, sheet, row of the rows whose filled cells are all bold: headings, or offers where a list prints them so."""
    filled = found.where("value is not null").groupBy("path", "sheet", "row").agg(F.bool_and("bold").alias("all"))
    return filled.where("all").drop("all")
