"""JSON of any form: one canonical text, and lists from whatever is given."""

from pyspark.sql import functions as F

from priceweave.functions import documents


def one(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_canonical_texts(spark):
    same = ['{"b": 1, "a": [1, {"d": null, "c": "é"}]}', '{"a":[1,{"c":"\\u00e9","d":null}],"b":1.0}', ' {"b":1,\n"a":[1,{"d":null,"c":"é"}]} ']
    got = one(spark, [*same, '{"a":[{"c":"é","d":null},1],"b":1}', "[]", '"x"', "nothing", None, ""], documents.canonical)
    assert got[0] == got[1] == got[2] == '{"a":[1,{"c":"é","d":null}],"b":1}'
    assert got[3] != got[0] and got[4:6] == ["[]", '"x"'] and got[6:] == [None, None, None]
    prints = one(spark, same, lambda c: documents.json_fingerprint(c, 16))
    assert len(set(prints)) == 1 and len(prints[0]) == 16


def test_lists_from_any_form(spark):
    texts = ['["a", 1, null, 2.5]', '"a"', "7", '{"b": "y", "a": "x"}', "null", "[]", "{}", None, "not json", "true"]
    assert one(spark, texts, documents.listed) == [["a", "1", "2.5"], ["a"], ["7"], ["x", "y"], [], [], [], [], [], ["true"]]
    assert one(spark, ['{"k": [1, 2]}', '{"k": 1}', "{}"], lambda c: documents.listed(c, "$.k")) == [["1", "2"], ["1"], []]


def test_eligible_of_any_form(spark):
    texts = ['{"products": "p", "eans": [1, "", null], "source_rows": [2, "3", "x"], "group": "g", "mix_allowed": false}', '["a", "", null, 2]', '"a"', "5", "plain words", '{"group": ""}', "", None, "[]"]
    got = [tuple(x) for x in one(spark, texts, lambda c: documents.eligible(c, F.lit("d")))]
    assert got == [(["p"], ["1"], [2, 3], "g", False), (["a", "2"], [], [], "d", None), (["a"], [], [], "d", None), (["5"], [], [], "d", None), (["plain words"], [], [], "d", None), ([], [], [], "d", None), ([], [], [], "d", None), ([], [], [], "d", None), ([], [], [], "d", None)]
