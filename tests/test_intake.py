"""Whole shortlists against all pairs, and rules that no query of the catalogue reaches."""

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from priceweave.functions.sizes import pack_sizes
from priceweave.operators import conditions, intake

ROWS = [("A", 1, "0001", "Sapone Rosa ml 500", 1.0, True, None), ("A", 2, "0002", "Sapone Rosa 250 ml", 1.0, True, None), ("A", 3, "0001", "Tutt'altro", 2.0, True, None), ("A", 4, "0004", "Sapone Rosa ml 500", None, True, None), ("A", 5, "0005", "Sapone ml 500", 1.0, True, "DISPLAY_COMPONENT"), ("A", 6, "", "Rosa Sapone ml 500", 1.0, None, None), ("B", 1, "0001", "Sapone", 1.0, True, None), ("A", 7, None, "Rosa", 1.0, True, None)]
QUEUE = [(10, "A", "0001", "Sapone rosa ml 500"), (11, "A", "", "Rosa 250 ml"), (12, "B", "9", "Sapone"), (13, "A", None, None)]


def _score(a, b):
    words = lambda t: {w for w in t.upper().replace("'", " ").split() if len(w) > 1}
    plain = lambda t: t.upper().replace("'", " ")
    x, y = words(a), words(b)
    sa, sb = pack_sizes(a), pack_sizes(b)
    shared = set(sa) & set(sb)
    bad = [u for u in shared if not any(abs(p - q) <= max(max(p, q) * 0.02, 0.01) for p in sa[u] for q in sb[u])]
    sizes = (len(shared) - len(bad)) / len(shared) if shared else 0.5
    total = 0.45 * len(x & y) / len(x | y) + 0.35 * SequenceMatcher(None, plain(a), plain(b), autojunk=False).ratio() + 0.2 * sizes - (0.35 if bad else 0)
    return len(x & y), max(total, 0)


def test_shortlists_equal_all_pairs(spark):
    rows = spark.createDataFrame(ROWS, "supplier string, iid long, ean string, description string, price double, usable boolean, row_type string")
    queue = spark.createDataFrame(QUEUE, "qid long, supplier string, ean string, description string")
    got = [(r["qid"], r["iid"], r["same_ean"], round(r["score"], 4)) for r in intake.shortlists(queue, rows, 2).orderBy("qid", "rank").collect()]
    want = []
    for qid, supplier, ean, description in QUEUE:
        found = []
        for s, iid, code, name, price, usable, kind in ROWS:
            if s == supplier and description and price and usable is not False and kind is None:
                shared, score = _score(description, name)
                same = bool(ean) and ean == code
                if shared or same:
                    found.append((not same, -round(score, 4), iid))
        found.sort()
        k = max(2, sum(not f[0] for f in found))
        want += [(qid, iid, not other, -score) for other, score, iid in found[:k]]
    assert got == want


def test_blocks_lose_nothing(spark):
    rows = [("s", 1, "in omaggio 1 ct di", "gel", ""), ("s", 2, "Acquistando 5 ct", "", ""), ("s", 3, "gel blu", "", "1"), ("s", 4, "in omaggio 1 ct di", "gel rosso", "9"), ("s", 5, "Acquistando 4 ct", "", ""), ("s", 6, "Acquistando 3 ct", "", ""), ("s", 7, None, None, None), ("s", 12, "note", "", ""), ("s", 13, "Acquistando 2 ct", "", ""), ("s", 14, "gel", "", "2")]
    df = spark.createDataFrame(rows, "supplier string, row long, text string, reward_name string, ean string").withColumn("orderable", F.lit(True))
    got = {(r["first_row"], r["last_row"]): (r["reason"], list(r["eligible_rows"]), r["threshold"]) for r in conditions.block_conditions(df, 5).collect()}
    assert got == {(1, 1): ("NO_HEADING", [], None), (2, 4): (None, [3], 5), (5, 5): ("NEXT_HEADING", [], None), (6, 12): ("NO_REWARD", [], None), (13, 14): ("SHEET_ENDS", [14], None)}


def test_component_cells(spark):
    cells = [["", "", "", "", "", "", "12", "12", "Gel è", "3", "", "", "", "", "99"], ["x"], None]
    df = spark.createDataFrame([(c,) for c in cells], "cells array<string>")
    out = df.select(conditions.component_text(F.col("cells")).alias("t"), conditions.component_quantity(F.col("cells")).alias("n"), intake.readable_identity(F.lit("S|1||A B")).alias("i")).collect()
    assert [(r["t"], r["n"]) for r in out] == [("Gel è", 12), (None, None), (None, None)]
    assert tuple(out[0]["i"]) == ("S", "1", "", "A B", "s 1 a b")
