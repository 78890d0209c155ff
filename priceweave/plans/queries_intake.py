"""Queries of intake and delivery over the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake
from .registry import doubles, query
from .tables import SQL_PRICE_LIST, price_list, read, reorder


def _catalogue(spark, sf):
    k = F.col("p_partkey")
    rows = read(spark, sf, "part").select(k.alias("row"), F.when(k % 17 == 0, " ").otherwise(F.concat(F.lit(" "), F.upper("p_name"), F.lit("  "))).alias("product"), F.when(k % 19 == 0, "ask").when(k % 13 == 0, "1.50").when(k % 11 == 0, "0").otherwise(F.concat(F.lit("1."), F.lpad((k % 7).cast("string"), 3, "0"), F.lit(",50"))).alias("price"), F.when(k % 23 == 0, "0").otherwise((k % 40 + 1).cast("string")).alias("page"))
    return intake.checked_catalogue(rows, "product", "price", "page")


_CATALOGUE = """WITH r AS (SELECT p_partkey AS row, p_partkey % 17 = 0 AS blank, p_partkey % 19 = 0 OR p_partkey % 13 = 0 AS unpriced, p_name AS name, CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_partkey % 7 END AS price, CASE WHEN p_partkey % 23 = 0 THEN 0 ELSE p_partkey % 40 + 1 END AS page FROM part),
d AS (SELECT row, page, CASE WHEN blank THEN 'NO_DESCRIPTION' WHEN unpriced THEN 'NO_PRICE' WHEN row <> min(CASE WHEN NOT blank AND NOT unpriced THEN row END) OVER (PARTITION BY blank OR unpriced, name, price) THEN 'DUPLICATE' WHEN page < 1 THEN 'NO_PAGE' END AS discarded FROM r)"""


@query(f"{_CATALOGUE} SELECT row, discarded FROM d")
def checked_catalogue(spark, sf):
    return _catalogue(spark, sf).select("row", "discarded")


@query(f"""{_CATALOGUE} SELECT count(*) AS n_read, count(*) FILTER (WHERE discarded IS NULL) AS n_kept, max(page) FILTER (WHERE discarded IS NULL) AS last_page, count(*) FILTER (WHERE discarded = 'NO_DESCRIPTION') AS n_no_description, count(*) FILTER (WHERE discarded = 'NO_PRICE') AS n_no_price, count(*) FILTER (WHERE discarded = 'DUPLICATE') AS n_duplicate, count(*) FILTER (WHERE discarded = 'NO_PAGE') AS n_no_page,
  max(page) FILTER (WHERE discarded IS NULL) - count(DISTINCT page) FILTER (WHERE discarded IS NULL) AS n_missing_pages FROM d""")
def catalogue_report(spark, sf):
    return intake.catalogue_report(_catalogue(spark, sf), "page")


@query(f"""WITH {SQL_PRICE_LIST}, c AS (SELECT CASE WHEN o_custkey % 6 = 0 THEN 'NOBODY' ELSE 'NATION_' || o_custkey % 25 END AS supplier, o_orderkey * 10 + 1 AS source_row FROM orders)
SELECT c.supplier, c.source_row, CAST(CASE WHEN p.usable THEN unit_price_net END AS DOUBLE) AS unit_price_net, CAST(CASE WHEN p.usable THEN pieces_per_carton END AS DOUBLE) AS pieces_per_carton,
  CASE WHEN c.supplier NOT IN (SELECT supplier FROM price_list) THEN 'NO_LIST' WHEN p.supplier IS NULL THEN 'NO_ROW' WHEN NOT p.usable THEN 'NOT_ORDERABLE' END AS error FROM c LEFT JOIN (SELECT DISTINCT * FROM price_list) p ON p.supplier = c.supplier AND p.source_row = c.source_row""")
def offers_from_rows(spark, sf):
    name = F.when(F.col("o_custkey") % 6 == 0, "NOBODY").otherwise(F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")))
    chosen = read(spark, sf, "orders").select(name.alias("supplier"), (F.col("o_orderkey") * 10 + 1).alias("source_row"))
    return doubles(intake.offers_from_rows(chosen, price_list(spark, sf).distinct()))


@query("""SELECT p_partkey AS source_row, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'mine' ELSE p_brand END AS supplier, CASE WHEN p_partkey % 3 = 0 THEN greatest(p_size - 10, 0) ELSE p_size END AS quantity, p_partkey % 3 = 0 AND p_partkey % 2 = 0 AS by_user FROM part""")
def saved_choices(spark, sf):
    k = F.col("p_partkey")
    p = read(spark, sf, "part")
    automatic = p.select(k.alias("source_row"), F.col("p_brand").alias("supplier"), F.col("p_size").alias("quantity"))
    saved = p.where(k % 3 == 0).select(k.alias("source_row"), F.lit("mine").alias("supplier"), (F.col("p_size") - 10).alias("quantity"), (k % 2 == 0).alias("by_user"))
    return intake.with_saved_choices(automatic, saved)


@query("""SELECT p_partkey AS row, CASE WHEN p_size % 4 > 1 THEN CASE WHEN p_size % 5 = 0 THEN 'ERROR' ELSE 'VERIFIED' END WHEN p_size % 4 = 0 THEN 'UNCHECKED' WHEN p_size % 7 = 0 THEN 'WARNING' ELSE 'VERIFIED' END AS outcome FROM part""")
def destination_checks(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    p = read(spark, sf, "part")
    plan = p.select(F.lit("S").alias("supplier"), k.alias("row"), F.when(size % 4 > 1, k.cast("string")).otherwise("").alias("ean"), F.when(size % 4 != 0, F.upper("p_name")).alias("description"))
    rows = p.select(F.lit("S").alias("supplier"), k.alias("row"), F.when(size % 5 == 0, "").otherwise(F.concat(k.cast("string"), F.lit(".0"))).alias("ean"), F.when(size % 7 == 0, "other").otherwise(F.col("p_name")).alias("description"))
    return intake.destinations(plan, rows).select("row", "outcome")


@query("SELECT max(p_partkey) AS last_row FROM part WHERE p_size > 40 OR p_partkey % 100 = 3")
def end_of_data(spark, sf):
    k = F.col("p_partkey")
    grid = read(spark, sf, "part").select(k.alias("source_row"), F.array(F.lit("x"), F.when(F.col("p_size") > 40, "a"), F.when(k % 100 == 3, "b").otherwise(" ")).alias("cells"))
    return intake.end_of_data(grid, [2, 3], 1)


@query()
def shortlists(spark, sf):
    """Of each product, asked of its brand's list: the row of its code, then the five best by words, sizes and blocks."""
    p = reorder(spark, sf)
    queue = p.select(F.col("source_row").alias("qid"), F.col("brand").alias("supplier"), "ean", "description")
    rows = p.select(F.col("brand").alias("supplier"), F.col("source_row").alias("iid"), "ean", "description", F.col("last_unit_price").alias("price"), F.lit(True).alias("usable"), F.lit(None).cast("string").alias("row_type"))
    return intake.shortlists(queue, rows, 5)
