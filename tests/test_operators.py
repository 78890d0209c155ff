"""Operators on small frames with the awkward cases that the test tables lack."""

import datetime

from pyspark.sql import functions as F

from priceweave.functions import numbers, text
from priceweave.operators import aggregates, displays, history, matching, offers, promotions, recognition
from priceweave.operators.graph import components


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_numbers(spark):
    rows = [("1.234,50", True), ("1,5", True), ("2.50", True), ("2.50", False), ("nan", False), ("", False), (None, True)]
    df = spark.createDataFrame(rows, "t string, italian boolean")
    got = [(str(a), str(b)) for a, b in df.select(numbers.number(F.col("t"), True), numbers.number(F.col("t"))).collect()]
    assert [g[0] for g in got] == ["1234.5000", "1.5000", "None", "None", "None", "None", "None"]
    assert [g[1] for g in got] == ["None", "None", "2.5000", "2.5000", "None", "None", "None"]
    codes = spark.createDataFrame([("4009428623194",), ("4009428623195",), ("96385074",), ("12",), (None,)], "c string")
    assert [r[0] for r in codes.select(numbers.gtin_valid(F.col("c"))).collect()][:4] == [True, False, True, False]
    counts = spark.createDataFrame([("ESPO X 96",), ("X 6 X 12",), ("X 6 o X6",), (None,)], "t string")
    assert [r[0] for r in counts.select(numbers.declared_quantity(F.col("t"))).collect()] == [96, None, 6, None]


def test_text(spark):
    df = spark.createDataFrame([(" 80010.0 ", "Crème brûlée, 2 pz"), ("00123", "DEODORANTE per la casa")], "e string, d string")
    assert [tuple(r) for r in df.select(text.ean(F.col("e")), text.matching_text(F.col("d"))).collect()] == [("80010", "CREME BRULEE, 2 PZ"), ("00123", "DEODORANTE PER LA CASA")]
    assert df.select(text.tokens(F.col("d"))).collect()[1][0] == ["DEO", "CASA"]
    n = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,)], "n int")
    assert [r[0] for r in n.select(text.column_letters(F.col("n"))).collect()] == ["A", "Z", "AA", "ZZ", "AAA"]



def test_equal_codes_find_rows(spark):
    rows = [("cipresso", 900, "4009428623194", "1.28"), ("noce", 4794, "8729721830575", "1.15"), ("betulla", 1751, "8729721830575", "1.19"), ("larice", 1056, "8729721830575", "1.1625")]
    prices = spark.createDataFrame([(s, r, e, p, "6", True) for s, r, e, p in rows], "supplier string, source_row long, ean string, p string, n string, usable boolean").selectExpr("supplier", "source_row", "ean", "cast(p as decimal(18,4)) unit_price_net", "cast(n as decimal(18,4)) pieces_per_carton", "usable")
    wanted = spark.createDataFrame([(330, "4009428623194")], "source_row long, ean string")
    matrix = matching.match_matrix(wanted, prices, prices.select("supplier"))
    assert values(matrix, "supplier", "status") == [("betulla", "ABSENT"), ("cipresso", "EXACT"), ("larice", "ABSENT"), ("noce", "ABSENT")]
    classes = matching.equivalence_classes(spark.createDataFrame([("4009428623194", "8729721830575")], "a string, b string"))
    both = matching.with_equivalences(wanted, prices, classes)
    assert {r["status"] for r in both.collect()} == {"EXACT"} and both.count() == 4


def test_cheapest_is_per_piece(spark):
    rows = [(1, "larice", "1.00", "12"), (1, "betulla", "0.90", "24"), (1, "cipresso", "1.20", "6"), (2, "noce", "1", "1"), (2, "larice", "1", "1")]
    o = spark.createDataFrame(rows, "source_row int, supplier string, u string, n string").selectExpr("source_row", "supplier", "cast(u as decimal(18,4)) unit_price", "cast(n as decimal(18,4)) pieces", "cast(u as decimal(18,4)) * cast(n as decimal(18,4)) order_price")
    assert values(offers.cheapest(o), "source_row", "supplier") == [(1, "betulla"), (2, "larice")]
    assert values(offers.cheapest(o, ["noce", "larice"]), "source_row", "supplier") == [(1, "betulla"), (2, "noce")]


def test_shortlist_keeps_every_row_of_the_code(spark):
    scored = spark.createDataFrame([(1, "s", i, i < 7, 0.1 * i) for i in range(12)], "qid int, supplier string, iid int, same_ean boolean, score double")
    assert {r["iid"] for r in matching.shortlist(scored, 5).collect()} == set(range(7))
    assert {r["iid"] for r in matching.shortlist(scored.withColumn("same_ean", F.lit(False)), 5).collect()} == {7, 8, 9, 10, 11}


def test_poisoned_sums(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, q int")
    assert values(df.groupBy("k").agg(aggregates.poisoned_sum(F.col("q")).alias("s")), "k", "s") == [("a", None), ("b", 5)]


def test_promotions(spark):
    texts = ["ACQUISTANDO 10 CT TRA: IN OMAGGIO 1 CT DI RESALINA SALE LAVASTOVIGLIE KG1", "70+8 gratis", "400+100 ml in omaggio", "niente", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(promotions.parse_text(F.col("t")).alias("p"))
    got = [r["p"] for r in df.collect()]
    assert (got[0]["kind"], got[0]["threshold"], got[0]["reward"], got[0]["reward_text"]) == ("THRESHOLD_GIFT", 10, 1, "RESALINA SALE LAVASTOVIGLIE KG1")
    assert (got[1]["kind"], got[1]["threshold"], got[1]["reward"]) == ("INCLUDED_PACK", 70, 8)
    assert got[2]["kind"] == "REVIEW" and got[3] is None and got[4] is None


def test_displays_need_contiguous_rows(spark):
    rows = [("s", 2, "PARENT", None)] + [("s", 3 + k, "COMPONENT", 6) for k in range(16)] + [("s", 30, "PARENT", None), ("s", 31, "COMPONENT", 1), ("s", 33, "COMPONENT", 1), ("s", 40, "COMPONENT", 2), ("s", 41, "COMPONENT", 2)]
    got = displays.bundles(spark.createDataFrame(rows, "sheet string, row int, kind string, quantity int"), ["sheet"], "row")
    assert values(got, "parent_row", "n_components", "pieces") == [(2, 16, 96)]


def test_expiry_boundary(spark):
    now = datetime.datetime(2024, 6, 1)
    day = lambda n: now - datetime.timedelta(days=n)
    rows = [(1, "pending", day(60), None), (2, "pending", day(61), None), (3, "pending", day(90), day(10)), (4, "received", day(90), None), (5, "pending", None, None)]
    df = spark.createDataFrame(rows, "id int, status string, created timestamp, answered timestamp")
    assert values(history.expired(df, F.lit(now)), "id") == [(2,), (5,)]


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1060)] + [(5, 5)]
    got = dict(values(components(spark.createDataFrame(edges, "a long, b long")), "node", "component"))
    assert got == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1060)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_recognition(spark):
    docs = spark.createDataFrame([("d", ["ean", "name", "price", "price"])], "document_id string, headers array<string>")
    adapters = spark.createDataFrame([("full", ["ean", "name"]), ("near", ["ean", "name", "price", "vat"]), ("far", ["x", "y"])], "adapter_id string, required array<string>")
    covered = recognition.coverage(docs, adapters)
    assert values(covered, "adapter_id", "state") == [("full", "KNOWN"), ("near", "NEAR")]
    assert values(recognition.best_adapter(covered), "adapter_id", "state") == [("full", "KNOWN")]


def test_promotional_texts(spark):
    gift = lambda *x: ("THRESHOLD_GIFT", *x)
    cases = {
        "Acqusitando almeno 3 cartoni ricevi in omaggio: 2 pz (misti) omaggio di sapone": gift(3, "CARTONS", 2, "PIECES", "SAPONE"),
        "OGNI 10CT RICEVI 1 espositore": gift(10, "CARTONS", 1, None, "ESPOSITORE"),
        "OGNI 10 CT2 RICEVI 1 CT di x": ("REVIEW", None, None, None, None, None),
        "OGNI 0 CT RICEVI 1 CT di x": ("REVIEW", None, None, None, None, None),
        "3OGNI 2 CT": None,
        "rasoi 8+2 gratis": ("INCLUDED_PACK", 8, None, 2, None, None),
        "mt.16+4 gratis": ("REVIEW", None, None, None, None, None),
        "2,5ML  8+2 gratis": ("INCLUDED_PACK", 8, None, 2, None, None),
        "500+100 omaggio=600 ml": ("REVIEW", None, None, None, None, None),
        "500+100 omaggio=600": ("INCLUDED_PACK", 500, None, 100, None, None),
        "1,5+1 gratis": ("REVIEW", None, None, None, None, None),
        "1 + 1": ("REVIEW", None, None, None, None, None),
        "21+1 pezzi": None,
        "promo": ("REVIEW", None, None, None, None, None),
        "promozioni": None,
        "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", promotions.parse_text(F.col("t")).alias("p"))
    assert {r["t"]: r["p"] and tuple(r["p"])[:6] for r in df.collect()} == cases
