"""Equal codes: their products meet as a class, not one by one."""

import random

from priceweave.operators import matching
from priceweave.plans import catalogue, queries_matching


def test_equal_products_have_an_edge_each(spark, tmp_path, monkeypatch):
    rows = [(k, "blue anvil", "B1", 1 + (k > 50), 1.0) for k in range(1, 61)] + [(61, None, "B1", 1, 1.0), (62, None, "B1", 1, 1.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    plain = matching.equivalence_classes
    monkeypatch.setattr(queries_matching.matching, "equivalence_classes", lambda edges: seen.append(edges.count()) or plain(edges))
    got = {int(r["code"]): int(r["class"]) for r in catalogue.queries()["equivalence_closure"](spark, str(tmp_path)).collect()}
    assert got == {k: 1 if k <= 50 else 51 for k in range(1, 61)}
    assert seen == [49 + 9]


def test_candidates_by_equal_codes_are_those_of_all_others(spark):
    r = random.Random(1)
    classes = {f"c{i}": f"c{i % 4}" for i in range(16)}
    products = [(i, f"c{i}") for i in range(20)]
    items = [(r.choice("xyz"), f"c{r.randint(0, 21)}", r.random() < 0.6, n) for n in range(70)]
    got = matching.with_equivalences(
        spark.createDataFrame(products, "source_row long, ean string"),
        spark.createDataFrame(items, "supplier string, ean string, usable boolean, source_row long"),
        spark.createDataFrame(list(classes.items()), "code string, class string"),
    )
    want = set()
    for row, code in products:
        for s in "xyz":
            own = [i for i in items if i[0] == s and i[1] == code]
            via = [i for i in items if i[0] == s and i[1] != code and code in classes and classes.get(i[1]) == classes[code]]
            usable = sum(i[2] for i in own + via)
            if own or via:
                want.add((row, s, len(own), len(via), "EXACT" if usable == 1 else "AMBIGUOUS" if usable else "PRESENT_UNUSABLE"))
    assert {(x["source_row"], x["supplier"], x["n_exact"], x["n_via"], x["status"]) for x in got.collect()} == want and got.count() == len(want)
