"""A shortlist's candidates are all rows that share a word or the code."""

import random

from priceweave.operators import matching
from priceweave.plans import catalogue


def best(products, items, words, k):
    out = set()
    for qid, own, tokens in products:
        there = [i for i in items if i[2] == own or set(words[i[2]]) & set(tokens)]
        for supplier in {i[0] for i in there}:
            ranked = sorted((i for i in there if i[0] == supplier), key=lambda i: (i[2] != own, -i[3], i[1]))
            out |= {(qid, i[0], i[1], i[2] == own, i[3]) for i in ranked[: max(k, sum(i[2] == own for i in ranked))]}
    return out


def test_best_rows_of_words_give_the_shortlist_of_all_rows(spark):
    r = random.Random(4)
    words = {f"e{i}": r.sample("abcdefgh", r.randint(0, 3)) for i in range(25)}
    products = [(i, e, w) for i, (e, w) in enumerate(words.items())]
    items = [(r.choice("xy"), i, r.choice(list(words)[:12]), r.randint(0, 3) / 4) for i in range(150)]
    p = spark.createDataFrame(products, "qid long, ean string, tokens array<string>")
    rows = spark.createDataFrame(items, "supplier string, iid long, ean string, score double")
    for k in (1, 2, 5):
        got = matching.forced_shortlist(p, rows, p.select("ean", "tokens"), k).drop("rank").collect()
        assert len(got) == len({tuple(x) for x in got})
        assert {tuple(x) for x in got} == best(products, items, words, k)


def test_rows_that_share_a_word_are_candidates(spark, tmp_path):
    tables = {
        "part": ([(1, "blue anvil", "B1", 1, 1.0), (2, "blue hammer", "B2", 2, 1.0), (900, "green saw", "B3", 3, 1.0)], "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"),
        "lineitem": ([(1, 1, 2, 1, 5.0, 1.0, 0.1, "N", "O"), (2, 1, 900, 1, 5.0, 1.0, 0.1, "N", "O")], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string"),
        "supplier": ([(1, 1)], "s_suppkey long, s_nationkey int"),
        "nation": ([(1, "PERU")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["qid"], r["iid"], r["same_ean"]) for r in catalogue.queries()["ean_forced_shortlist"](spark, str(tmp_path)).collect()}
    assert got == {(1, 11, False), (2, 11, True), (900, 21, True)}


def test_rows_of_one_number_and_different_codes_are_each_a_candidate(spark):
    p = spark.createDataFrame([(1, "e1", ["blue"]), (2, "e2", ["blue"]), (3, "e3", ["blue", "saw"]), (4, "e4", [])], "qid long, ean string, tokens array<string>")
    items = [("x", 11, "e2", 0.5), ("x", 11, "e3", 0.5), ("x", 12, "e3", 0.4), ("y", 13, "e4", 0.1), ("x", 14, "e1", None)]
    rows = spark.createDataFrame(items, "supplier string, iid long, ean string, score double")
    got = sorted((r["qid"], r["supplier"], r["iid"], r["same_ean"]) for r in matching.forced_shortlist(p, rows, p.select("ean", "tokens"), 2).collect())
    assert got == [(1, "x", 11, False), (1, "x", 14, True), (2, "x", 11, False), (2, "x", 11, True), (3, "x", 11, True), (3, "x", 12, True), (4, "y", 13, True)]
    got = [r["iid"] for r in matching.forced_shortlist(p, rows.where("ean <> 'e1'"), p.select("ean", "tokens"), 2).where("qid = 1").collect()]
    assert got == [11, 11]
