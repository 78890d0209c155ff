"""Queries over JSON of any form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents
from .registry import query
from .tables import read


@query("""SELECT o_orderkey, sha256('{"a":{"s":"' || o_orderpriority || '","t":null},"k":' || o_orderkey || ',"l":[1,' || o_custkey || ',"x y"]}') AS fingerprint FROM orders""")
def canonical_fingerprints(spark, sf):
    """Of entries whose keys stand in three orders, with and without white space."""
    key, name = F.col("o_orderkey").cast("string"), F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    items = F.concat(F.lit("[ 1,"), F.col("o_custkey").cast("string"), F.lit(' , "x y"]'))
    forms = [
        F.concat(F.lit('{"k": '), key, F.lit(', "l" :'), items, F.lit(', "a": {"t": null, "s": '), name, F.lit("}}")),
        F.concat(F.lit('{"l":'), items, F.lit(',"a":{"s":'), name, F.lit(',"t":null},"k":'), key, F.lit("}")),
        F.concat(F.lit(' {\n"a" : { "s" : '), name, F.lit(' ,\n"t":null } , "k":'), key, F.lit(',"l":'), items, F.lit(" }\n")),
    ]
    number = F.col("o_orderkey") % 3
    return read(spark, sf, "orders").select("o_orderkey", documents.json_fingerprint(F.when(number == 0, forms[0]).when(number == 1, forms[1]).otherwise(forms[2])).alias("fingerprint"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k, p_partkey % 5 AS form, p_brand FROM part)
SELECT p_partkey, CASE form WHEN 0 THEN k WHEN 1 THEN k || ',b' WHEN 2 THEN k WHEN 3 THEN '' ELSE 'no json ' || k END AS products, CASE form WHEN 2 THEN '8' || k || ',9' ELSE '' END AS eans, CASE form WHEN 2 THEN k ELSE '' END AS source_rows,
  CASE form WHEN 2 THEN p_brand ELSE 'all' END AS "group", CASE form WHEN 2 THEN true END AS mix_allowed FROM p""")
def eligible_of_any_form(spark, sf):
    """A scalar, an array, an object with scalars and arrays, an empty object and a text that is no JSON."""
    key, form = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    whole = F.concat(F.lit('{"source_rows": "'), key, F.lit('", "eans": ["8'), key, F.lit('", 9, null, ""], "products":'), key, F.lit(', "mix_allowed": true, "group": "'), F.col("p_brand"), F.lit('"}'))
    text = F.when(form == 0, key).when(form == 1, F.concat(F.lit("["), key, F.lit(', null, "b", ""]'))).when(form == 2, whole).when(form == 3, F.lit('{"group": ""}')).otherwise(F.concat(F.lit("no json "), key))
    x = read(spark, sf, "part").select("p_partkey", documents.eligible(text, F.lit("all")).alias("x"))
    joined = lambda c: F.array_join(f"x.{c}", ",").alias(c)
    return x.select("p_partkey", joined("products"), joined("eans"), joined("source_rows"), "x.group", "x.mix_allowed")
