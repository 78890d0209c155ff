"""Formulas, kinds of their values and bold print of workbooks."""

import zipfile

from pyspark.sql import functions as F

from priceweave.sources.cells import bold_rows, cells, formula_kinds, moved

from .test_sources import BOOK, RELS, STRINGS

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
STYLES = f'<styleSheet {NS}><fonts><font/><font><b/></font><font><b val="0"/></font></fonts><cellXfs><xf fontId="0"/><xf fontId="1"/><xf fontId="2"/></cellXfs></styleSheet>'
SHEET = f"""<worksheet {NS}><sheetData>
<row r="1"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1" t="inlineStr" s="1"><is><t>Price</t></is></c></row>
<row r="2"><c r="A2"><v>3</v></c><c r="B2"><f t="shared" ref="B2:B5" si="0">A2*$C$1+SUM(A$1:A2)&amp;"A2"</f><v>7.5</v></c><c r="C2" s="1"><v>1</v></c></row>
<row r="3"><c r="A3" s="2"><v>4</v></c><c r="B3"><f t="shared" si="0"/><v>9</v></c></row>
<row r="4"><c r="B4" t="str"><f t="shared" si="0"/><v>ask</v></c></row>
<row r="5"><c r="B5" t="e"><f t="shared" si="0"/><v>#DIV/0!</v></c><c r="C5" t="b"><f>NOT(A1)</f><v>1</v></c><c r="D5"><f>B5</f></c></row>
</sheetData></worksheet>"""


def test_cells_of_a_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        for name, text in (("xl/workbook.xml", BOOK), ("xl/_rels/workbook.xml.rels", RELS), ("xl/sharedStrings.xml", STRINGS), ("xl/styles.xml", STYLES), ("xl/worksheets/sheet1.xml", SHEET)):
            z.writestr(name, text)
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04 broken")
    found = cells(spark, str(tmp_path))
    assert [r["error"][:10] for r in found.where("error is not null").collect()] == ["BadZipFile"]
    got = {(r["row"], r["col"]): (r["value"], r["kind"], r["formula"], r["bold"]) for r in found.where("error is null").collect()}
    assert got[1, 1] == ("EAN", "text", None, True) and got[3, 1] == ("4", "number", None, False)
    assert got[2, 2] == ("7.5", "number", 'A2*$C$1+SUM(A$1:A2)&"A2"', False)
    assert got[4, 2] == ("ask", "text", 'A4*$C$1+SUM(A$1:A4)&"A2"', False)
    assert got[5, 4] == (None, None, "B5", False)
    kinds = {(r["col"], r["kind"]): r["n"] for r in formula_kinds(found).collect()}
    assert kinds == {(2, "number"): 2, (2, "text"): 1, (2, "error"): 1, (3, "boolean"): 1, (4, "none"): 1}
    assert [r["row"] for r in bold_rows(found).select("row").orderBy("row").collect()] == [1]
    assert found.where(F.col("sheet") != "List").count() == 0


def test_formulas_move_with_their_cells():
    assert moved("A1+$A1+A$1+$A$1", 2, 3) == "D3+$A3+D$1+$A$1"
    assert moved("Z9*AA10", 1, 1) == "AA10*AB11"
    assert moved("A1+B2", -1, 0) == "#REF!+B1" and moved("LOG10(B1)+'Tab A1'!C1+\"A1\"", 1, 0) == "LOG10(B2)+'Tab A1'!C2+\"A1\""
    assert moved("TAX2024X+A1_b", 1, 1) == "TAX2024X+A1_b"
