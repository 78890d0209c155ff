"""Lists that fail beside lists that don't, and the counters of a reading."""

import os
import zipfile

import pytest

from priceweave.sources.adapters import Counters, Mapping, records, with_choices
from priceweave.sources.lists import grids


def test_broken_and_unreadable_files_are_rows(spark, tmp_path):
    for k in range(8):
        (tmp_path / f"good{k}.csv").write_text("code;price\n" + "".join(f"{i};{i},5\n" for i in range(5000 if k == 0 else 3)))
    (tmp_path / "broken.xlsx").write_bytes(b"PK\x03\x04 no archive")
    with zipfile.ZipFile(tmp_path / "other.xlsx", "w") as z:
        z.writestr("readme.txt", "no workbook")
    (tmp_path / "old.xls").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x" * 600)
    (tmp_path / "empty.csv").write_bytes(b"")
    locked = tmp_path / "locked.csv"
    locked.write_text("a;b\n1;2\n")
    os.chmod(locked, 0)
    can_read = os.access(locked, os.R_OK)
    rows, files = grids(spark, str(tmp_path), delimiter=";")
    got = {os.path.basename(r["path"]): (r["n_rows"], r["error"]) for r in files.collect()}
    assert len(got) == 13
    assert all(got[f"good{k}.csv"] == (5001 if k == 0 else 4, None) for k in range(8))
    assert got["empty.csv"] == (0, "unreadable or empty")
    assert got["broken.xlsx"][0] == 0 and "BadZipFile" in got["broken.xlsx"][1]
    assert "KeyError" in got["other.xlsx"][1] and "older binary" in got["old.xls"][1]
    assert got["locked.csv"] == ((2, None) if can_read else (0, "unreadable or empty"))
    counted = {os.path.basename(r["path"]): r["count"] for r in rows.groupBy("path").count().collect()}
    assert {n for n in counted if n.startswith("good")} == {f"good{k}.csv" for k in range(8)} and counted["good0.csv"] == 5001
    assert not {"broken.xlsx", "other.xlsx", "old.xls"} & set(counted)
    os.chmod(locked, 0o600)


def test_counters_count_each_row_once(spark):
    cells = [["code", "what", "price"], ["1", "soap", "2,5"], ["2", "", "1"], ["x", "soap", "1"], ["3", "sample", "1"], ["4", "soap", "ask"], [" ", " ", " "], ["5", None, None]]
    grid = spark.createDataFrame([(i + 1, c) for i, c in enumerate(cells)], "source_row int, cells array<string>")
    mapping = Mapping("s", {"supplier_code": 1, "description": "what", "unit_price_net": "price"}, header_row=1, data_start=2, italian=True, needs_pieces=False, filters=[("supplier_code", r"\d")], excludes=[("sample", "description", "sample")], required_headers=("What", "price"))
    counters = Counters()
    rows = records(grid, mapping, counters)
    got = rows.collect()
    assert counters.values() == {"read": 7, "filtered": 2, "no_product": 1, "kept": 1, "excluded: sample": 1, "unusable: no description": 1, "unusable: no price": 1}
    assert [r["supplier_code"] for r in got] == ["1", "2", "3", "4"]


def test_missing_headers_are_named(spark):
    grid = spark.createDataFrame([(1, ["code", "price"])], "source_row int, cells array<string>")
    with pytest.raises(ValueError, match="lacks what, ean; it has code, price"):
        records(grid, Mapping("s", {"description": 1}, header_row=1, required_headers=("what", "price", "ean")))


def test_multiplier_in_a_text(spark):
    grid = spark.createDataFrame([(1, ["a", "1", "Ct X 1.012,0"]), (2, ["b", "1", "12"])], "source_row int, cells array<string>")
    mapping = Mapping("s", {"description": 1, "unit_price_net": 2, "order_multiplier": 3}, italian=True, multiplier_pattern=r"x\s*([\d.]+(?:,\d+)?)")
    got = {r["description"]: (r["pieces_per_carton"], r["unusable_reason"]) for r in records(grid, mapping).collect()}
    assert float(got["a"][0]) == 1012 and got["b"] == (None, "no pieces")


def test_columns_of_a_user_go_over_the_declared_ones():
    header = ["Code", "What it is", "Price", "Price list", None, "Box"]
    mapping = Mapping("s", {"supplier_code": 1, "description": "B", "unit_price_net": "price", "discount": 5})
    got = with_choices(mapping, {"unit_price_net": "PRICE-LIST", "pieces_per_carton": 6, "discount": None}, header)
    assert got.columns == {"supplier_code": 1, "description": 2, "unit_price_net": 4, "pieces_per_carton": 6} and mapping.columns["discount"] == 5
    with pytest.raises(ValueError) as e:
        with_choices(mapping, {"price": 1, "ean": "bar code", "packaging": 2, "pieces_per_carton": 9}, header)
    said = str(e.value)
    assert "price: no such field" in said and "ean: 0 columns" in said and "column 2: description and packaging" in said and "column 9 of 6" in said
