import zipfile

import pytest

from priceweave.sources.adapters import Mapping, column_number, records
from priceweave.sources.files import binary_files, profiles
from priceweave.sources.sheets import SheetSource, csv_rows, sniff_delimiter

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>12.5</v></c></row><row r="5"><c r="B5" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>"""
BOOK = """<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="List" sheetId="1" r:id="rId1"/></sheets></workbook>"""
RELS = """<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>"""
STRINGS = """<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>EAN</t></si></sst>"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "list.csv").write_text('intro;;;\nCode;Name;Price;Pieces\n8000000000001.0;"Soap\nlong";1.234,50;12\n;;;\n8000000000002;Gel;2,5;\n8000000000003;Old gel;3;6\n', encoding="utf-8-sig")
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        for name, text in (("xl/workbook.xml", BOOK), ("xl/_rels/workbook.xml.rels", RELS), ("xl/sharedStrings.xml", STRINGS), ("xl/worksheets/sheet1.xml", SHEET)):
            z.writestr(name, text)
    return tmp_path


def test_sheets(spark, folder):
    spark.dataSource.register(SheetSource)
    rows = spark.read.format("sheet").load(str(folder)).collect()
    book = [(r["sheet"], r["source_row"], r["cells"]) for r in rows if r["path"].endswith("xlsx")]
    assert book == [("List", 2, ["EAN", None, "12.5"]), ("List", 5, [None, "x"])]
    lines = {r["source_row"]: r["cells"] for r in rows if r["path"].endswith("csv")}
    assert lines[3][1] == "Soap\nlong" and lines[6][1] == "Gel"  # physical lines


def test_profiles_go_by_content(spark, folder):
    found = {r["path"].rsplit("/", 1)[1]: r["format"] for r in profiles(binary_files(spark, str(folder))).collect()}
    assert found == {"list.csv": "csv", "book.xlsx": "xlsx"}


def test_records(spark, folder):
    spark.dataSource.register(SheetSource)
    grid = spark.read.format("sheet").load(str(folder / "list.csv"))
    mapping = Mapping("S", {"ean": "code", "description": "B", "unit_price_net": 3, "pieces_per_carton": "Pieces"}, header_row=2, start_marker=(1, "code"), italian=True, excludes=[("old", "description", "^old")])
    got = {r["ean"]: r for r in records(grid, mapping).collect()}
    assert (str(got["8000000000001"]["unit_price_net"]), got["8000000000001"]["usable"]) == ("1234.5000", True)
    assert got["8000000000002"]["unusable_reason"] == "no pieces"
    assert got["8000000000003"]["excluded"] == "old" and not got["8000000000003"]["usable"] and len(got) == 3


def test_columns_and_delimiters():
    assert column_number("AB") == 28 and column_number("Net Price", ["x", "NET-PRICE"]) == 2
    with pytest.raises(ValueError):
        column_number("price", ["Price", "price "])
    assert sniff_delimiter("a|b\nc|d") == "|"
    with pytest.raises(ValueError):
        sniff_delimiter("one column\nonly")
    assert list(csv_rows(b"a,b\n\nc,\xe9\n")) == [(1, ["a", "b"]), (3, ["c", "é"])]
