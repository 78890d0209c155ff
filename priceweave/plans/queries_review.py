"""Queries on the review: upserts, overlays, rejections, carried decisions, plans and document checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review
from .registry import doubles, query
from .tables import read


def _half(spark, sf, year):
    o = read(spark, sf, "orders").where(F.year("o_orderdate") == year)
    return o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_order"), F.count("*").alias("n"))


_YEAR = "SELECT o_custkey, max(o_orderkey) AS last_order, count(*) AS n FROM orders WHERE year(o_orderdate) = {0} GROUP BY 1"


@query(f"WITH a AS ({_YEAR.format(1999)}), b AS ({_YEAR.format(2000)}) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(b.last_order, a.last_order) AS last_order, a.n FROM a FULL OUTER JOIN b ON a.o_custkey = b.o_custkey")
def upsert_offers(spark, sf):
    return review.upsert(_half(spark, sf, 1999), _half(spark, sf, 2000), ["o_custkey"], ["last_order"], ["n"])


@query("SELECT p_partkey, p_name, coalesce(CASE WHEN p_partkey % 9 = 0 THEN p_size + 100 END, p_size) AS p_size FROM part")
def overlay_overrides(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    set_ = p.where("p_partkey % 9 = 0").select("p_partkey", (F.col("p_size") + 100).alias("p_size"))
    return review.overlay(p, set_, ["p_partkey"], ["p_size"])


_OFFERS = "SELECT DISTINCT l_partkey AS product, l_suppkey AS supplier, l_suppkey % 7 AS article, l_suppkey % 3 AS code, l_suppkey % 5 <> 0 AS available FROM lineitem"


def _offers(spark, sf):
    s = F.col("l_suppkey")
    return read(spark, sf, "lineitem").select(F.col("l_partkey").alias("product"), s.alias("supplier"), (s % 7).alias("article"), (s % 3).alias("code"), (s % 5 != 0).alias("available")).distinct()


@query(f"""WITH o AS ({_OFFERS}), j AS (SELECT *, (product + supplier) % 11 = 0 AS rejected FROM o)
SELECT product, supplier, article, code, available AND NOT rejected AS available, rejected, bool_or(rejected) OVER (PARTITION BY product, code) AND NOT rejected AS needs_confirmation FROM j""")
def rejected_offers(spark, sf):
    o = _offers(spark, sf)
    return review.turn_off_rejected(o, o.where("(product + supplier) % 11 = 0"))


@query(f"WITH o AS ({_OFFERS}) SELECT *, product % 4 = 0 AND supplier % 2 = 0 AS in_force FROM o")
def confirmations_in_force(spark, sf):
    o = _offers(spark, sf)
    answers = o.where("product % 4 = 0").select("supplier", "product", F.when(F.col("supplier") % 2 == 0, F.col("article")).otherwise(-1).alias("article"), F.lit(True).alias("accepted"))
    return review.confirmed(o, answers)


@query("""SELECT coalesce(a.k, b.k) AS l_partkey, CASE WHEN b.k IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 3) a FULL OUTER JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def unmatched_both_sides(spark, sf):
    x = read(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    return review.unmatched_both(x.where("l_quantity < 3"), x.where("l_quantity > 48"), "l_partkey")


@query("""SELECT p_partkey, p_name FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey, 'extra' FROM part WHERE p_partkey % 3 = 0 AND p_size >= 30""")
def manual_products(spark, sf):
    p = read(spark, sf, "part")
    return review.append_missing(p.where("p_size < 30").select("p_partkey", "p_name"), p.where("p_partkey % 3 = 0").select("p_partkey", F.lit("extra").alias("p_name")), ["p_partkey"])


_PAIR = "SELECT l_partkey AS identity, l_suppkey AS supplier, min(l_extendedprice) AS price FROM lineitem WHERE l_linestatus = '{0}' GROUP BY ALL"


@query(f"""WITH d AS ({_PAIR.format('F')}), o AS ({_PAIR.format('O')})
SELECT d.identity, d.supplier, d.identity % 10 AS quantity, CASE WHEN d.identity % 20 = 0 OR o.price IS NULL THEN 'EXPIRED' WHEN o.price <> d.price THEN 'RESET' ELSE 'KEPT' END AS outcome FROM d LEFT JOIN o USING (identity, supplier)""")
def carried_decisions(spark, sf):
    x = read(spark, sf, "lineitem")
    pair = lambda s: x.where(F.col("l_linestatus") == s).groupBy(F.col("l_partkey").alias("identity"), F.col("l_suppkey").alias("supplier")).agg(F.min("l_extendedprice").alias("price"))
    products = read(spark, sf, "part").where("p_partkey % 20 <> 0").select(F.col("p_partkey").alias("identity"))
    return review.carried(pair("F").withColumn("quantity", F.col("identity") % 10), products, pair("O"))


_LINES = "SELECT p_partkey AS source_row, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_size - 3 END AS quantity, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS supplier, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_retailprice AS DECIMAL(18,4)) END AS order_price FROM part"


def _lines(spark, sf):
    k = F.col("p_partkey")
    return read(spark, sf, "part").select(k.alias("source_row"), F.when(k % 13 != 0, F.col("p_size") - 3).alias("quantity"), F.when(k % 5 != 0, F.col("p_brand")).alias("supplier"), F.when(k % 7 != 0, F.col("p_retailprice").cast("decimal(18,4)")).alias("order_price"))


@query(f"""WITH l AS ({_LINES}) SELECT source_row, 'no quantity' AS error FROM l WHERE quantity IS NULL UNION ALL SELECT source_row, 'negative quantity' FROM l WHERE quantity < 0
UNION ALL SELECT source_row, 'no supplier' FROM l WHERE supplier IS NULL AND quantity > 0 UNION ALL SELECT source_row, 'no price' FROM l WHERE supplier IS NOT NULL AND NOT coalesce(order_price > 0, false)""")
def plan_errors(spark, sf):
    return review.plan_errors(_lines(spark, sf))


@query(f"""WITH l AS ({_LINES}) SELECT supplier, count(*) AS n_lines, CAST(sum(CAST(quantity * order_price AS DECIMAL(18,4))) AS DOUBLE) AS total, NOT (sum(CAST(quantity * order_price AS DECIMAL(18,4))) > 0 AND sum(CAST(quantity * order_price AS DECIMAL(18,4))) < 2000000) AS reaches FROM l WHERE quantity > 0 AND supplier IS NOT NULL GROUP BY supplier""")
def order_plan(spark, sf):
    return doubles(review.order_plan(_lines(spark, sf), F.lit(2000000)))


_T = "SELECT p_brand AS supplier, sum(CAST(p_retailprice AS DECIMAL(18,4))) AS total FROM part WHERE p_partkey % 4 <> {0} GROUP BY 1"
_BELOW = "(coalesce({0}.total, 0) > 0 AND coalesce({0}.total, 0) < 90000)"


@query(f"""WITH b AS ({_T.format(0)}), a AS ({_T.format(1)}) SELECT coalesce(a.supplier, b.supplier) AS supplier, CASE WHEN {_BELOW.format('b')} AND NOT {_BELOW.format('a')} THEN 'reached' WHEN NOT {_BELOW.format('b')} AND {_BELOW.format('a')} THEN 'lost' WHEN {_BELOW.format('b')} THEN 'still below' ELSE 'unchanged' END AS note FROM a FULL OUTER JOIN b ON a.supplier = b.supplier""")
def threshold_notes(spark, sf):
    p = read(spark, sf, "part")
    total = lambda k: p.where(F.col("p_partkey") % 4 != k).groupBy(F.col("p_brand").alias("supplier")).agg(F.sum(F.col("p_retailprice").cast("decimal(18,4)")).alias("total"))
    return review.threshold_notes(total(0), total(1), F.lit(90000))


@query("SELECT min(l_partkey) AS first, max(l_partkey) AS last, count(DISTINCT l_partkey) AS pages, max(l_partkey) - min(l_partkey) + 1 - count(DISTINCT l_partkey) AS missing FROM lineitem")
def page_coverage(spark, sf):
    return review.page_coverage(read(spark, sf, "lineitem"), "l_partkey")


@query("SELECT p_size, count(*) AS n, count(DISTINCT lower(p_name)) < count(*) AS same_description FROM part GROUP BY p_size HAVING count(*) > 1")
def repeated_codes(spark, sf):
    return review.repeated_codes(read(spark, sf, "part").select("p_size", "p_name"), "p_size", "p_name")


@query("""SELECT p_partkey FROM (SELECT p_partkey, max(CASE WHEN p_size = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey // 500 ORDER BY p_partkey ROWS BETWEEN 6 PRECEDING AND 2 FOLLOWING) AS near FROM part) WHERE near = 1""")
def separator_context(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 500).alias("sheet"), (F.col("p_size") == 5).alias("mark"))
    return review.around(p, ["sheet"], "p_partkey", "mark").select("p_partkey")


@query("""WITH k AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT * FROM (SELECT p_brand, p_partkey, CASE WHEN k <= 12 THEN 'head' WHEN k > n - 12 THEN 'tail' WHEN k > floor((n - 5) / 2) AND k <= floor((n - 5) / 2) + 5 THEN 'middle' END AS part FROM k) WHERE part IS NOT NULL""")
def sampled_rows(spark, sf):
    return review.head_middle_tail(read(spark, sf, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def answers_to_ask(spark, sf):
    memory = read(spark, sf, "events").select(F.col("user_id").alias("o_custkey"), (F.col("event_type") == "purchase").alias("valid"))
    return review.answers_to_ask(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), memory, "o_custkey").select("o_orderkey")


@query("""WITH s AS (SELECT n_nationkey AS id, n_name AS entry FROM nation WHERE n_nationkey < 20), l AS (SELECT n_nationkey AS id, n_nationkey % 3 = 0 AS changed, 'own ' || n_name AS entry FROM nation WHERE n_nationkey % 2 = 0)
SELECT coalesce(s.id, l.id) AS id, CASE WHEN l.entry IS NOT NULL AND NOT (s.id IS NOT NULL AND l.changed) THEN l.entry ELSE s.entry END AS entry, CASE WHEN l.entry IS NOT NULL AND NOT (s.id IS NOT NULL AND l.changed) THEN 'learned' ELSE 'shipped' END AS origin FROM s FULL OUTER JOIN l ON s.id = l.id""")
def effective_registry(spark, sf):
    n = read(spark, sf, "nation")
    shipped = n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.lit("f").alias("fingerprint"), F.col("n_name").alias("entry"))
    learned = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, "old").otherwise("f").alias("base_fingerprint"), F.concat(F.lit("own "), "n_name").alias("entry"))
    return review.effective_registry(shipped, learned)
