"""Queries of declared conditions, displays on one row and checks of layouts over the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conditions, recognition
from .registry import doubles, query
from .tables import read

_K = "p_partkey % 9"
_TEXT = "CASE WHEN p_size % 11 = 0 THEN 'In omaggio 1 pz di ' || p_name ELSE p_name END"


@query(f"""WITH r AS (SELECT p_partkey AS source_row, p_size, {_TEXT} AS description, CASE {_K} WHEN 0 THEN ' sm ' WHEN 1 THEN 'TP' WHEN 2 THEN 'OK' END AS code FROM part)
SELECT source_row, CASE WHEN upper(trim(code)) = 'SM' THEN 'GIFT' WHEN upper(trim(code)) = 'TP' THEN 'TEMPORARY' WHEN p_size % 11 = 0 THEN 'REWARD' END AS row_type,
  p_size > 2 AND coalesce(upper(trim(code)), '') NOT IN ('SM', 'TP') AND p_size % 11 <> 0 AS usable FROM r""")
def marked_rows(spark, sf):
    k = F.col("p_partkey") % 9
    text = F.when(F.col("p_size") % 11 == 0, F.concat(F.lit("In omaggio 1 pz di "), "p_name")).otherwise(F.col("p_name"))
    records = read(spark, sf, "part").select(F.col("p_partkey").alias("source_row"), text.alias("description"), F.when(k == 0, " sm ").when(k == 1, "TP").when(k == 2, "OK").alias("row_code"), (F.col("p_size") > 2).alias("usable"))
    codes = spark.createDataFrame([("SM", False, "GIFT", "free goods"), ("tp", False, "TEMPORARY", "gone soon"), ("OK", True, None, None)], "code string, orderable boolean, row_type string, means string")
    return conditions.marked_rows(records, codes, "REWARD").select("source_row", "row_type", "usable")


# sheets of 500 rows: headings, gifts, products and rows that are none, by size
_ROWS = """rows AS (SELECT p_partkey // 500 AS supplier, p_partkey AS row, CASE WHEN p_size = 1 THEN 'Acquistando ' || (p_partkey % 9 + 1) || ' ct' WHEN p_size = 2 THEN 'Acquistando 3 scatole' WHEN p_size IN (3, 4) THEN 'in omaggio 1 ct di' ELSE p_name END AS text,
  CASE WHEN p_size IN (3, 4) THEN p_name ELSE '' END AS reward_name, CASE WHEN p_size < 40 THEN 'x' ELSE '' END AS ean, p_size % 10 <> 7 AS orderable, p_size IN (1, 2) AS heading, p_size IN (3, 4) AS gift FROM part)"""
_BLOCKS = f"""WITH {_ROWS}, b AS (SELECT *, NOT heading AND NOT gift AND ean <> '' AND orderable AS eligible, sum(CAST(heading AS INT)) OVER (PARTITION BY supplier ORDER BY row) AS block FROM rows),
s AS (SELECT *, max(CASE WHEN heading THEN row END) OVER (PARTITION BY supplier, block) AS start FROM b),
c AS (SELECT *, min(CASE WHEN start IS NOT NULL AND (gift OR (NOT eligible AND NOT heading AND row - start > 20)) THEN row END) OVER (PARTITION BY supplier, block) AS close FROM s),
g AS (SELECT supplier, block, start, close, max(CASE WHEN heading THEN text END) AS head, count(*) FILTER (WHERE eligible) AS n, coalesce(sum(row) FILTER (WHERE eligible), 0) AS rows, max(CASE WHEN gift AND row = close THEN text || ' ' || reward_name END) AS gift, max(row) AS last FROM c WHERE start IS NOT NULL AND (close IS NULL OR row <= close) GROUP BY ALL),
n AS (SELECT *, lead(start) OVER (PARTITION BY supplier ORDER BY block) AS next FROM g)"""


def _sheets(spark, sf):
    size = F.col("p_size")
    text = F.when(size == 1, F.concat(F.lit("Acquistando "), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit(" ct"))).when(size == 2, "Acquistando 3 scatole").when(size.isin(3, 4), "in omaggio 1 ct di").otherwise(F.col("p_name"))
    return read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 500).alias("supplier"), F.col("p_partkey").alias("row"), text.alias("text"), F.when(size.isin(3, 4), F.col("p_name")).otherwise("").alias("reward_name"), F.when(size < 40, "x").otherwise("").alias("ean"), (size % 10 != 7).alias("orderable"))


@query(f"""{_BLOCKS} SELECT supplier, start AS first_row, coalesce(close, next - 1, last) AS last_row, n AS n_eligible, CAST(rows AS BIGINT) AS eligible_sum, concat_ws(' ', head, gift) AS source_text,
  CASE WHEN gift IS NOT NULL AND head LIKE '% ct' THEN NULL WHEN gift IS NOT NULL THEN 'NO_THRESHOLD' WHEN close IS NOT NULL THEN 'NO_REWARD' WHEN next IS NOT NULL THEN 'NEXT_HEADING' ELSE 'SHEET_ENDS' END AS reason,
  CASE WHEN gift IS NOT NULL AND head LIKE '% ct' THEN CAST(regexp_extract(head, '\\d+') AS INT) END AS threshold FROM n
UNION ALL SELECT supplier, row, row, 0, 0, text || ' ' || reward_name, 'NO_HEADING', NULL FROM c WHERE gift AND (start IS NULL OR row > close)""")
def block_conditions(spark, sf):
    total = F.aggregate("eligible_rows", F.lit(0).cast("long"), lambda a, x: a + x)
    return conditions.block_conditions(_sheets(spark, sf), 20).select("supplier", "first_row", "last_row", F.size("eligible_rows").alias("n_eligible"), total.alias("eligible_sum"), "source_text", "reason", "threshold")


@query("""SELECT p_partkey // 500 AS supplier, p_partkey AS first_row, CASE WHEN p_size % 3 = 0 THEN 'THRESHOLD_GIFT' ELSE 'REVIEW' END AS kind, CASE WHEN p_size % 3 = 0 THEN p_size + 1 END AS threshold FROM part WHERE p_size % 3 < 2 AND (p_size % 7 <> 0)""")
def row_conditions(spark, sf):
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(F.lit("acquistando "), (size + 1).cast("string"), F.lit(" pz ricevi in omaggio 1 pz di "), "p_name")).when(size % 3 == 1, F.concat(F.lit("Offerta "), "p_name")).otherwise(F.col("p_name"))
    rows = read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 500).alias("supplier"), F.col("p_partkey").alias("row"), text.alias("text"), F.when(size % 7 == 0, "sm").alias("row_code"))
    codes = rows.select("supplier").distinct().select("supplier", F.lit("SM").alias("code"), F.lit(False).alias("orderable"))
    return conditions.row_conditions(rows, codes).select("supplier", "first_row", "kind", "threshold")


@query("""WITH d AS (SELECT DISTINCT n_name AS s, l_suppkey AS ref, CASE l_discount > 0.05 WHEN true THEN 'NUMERIC_DISCOUNT' ELSE 'REVIEW' END AS kind, l_returnflag AS text, l_discount > 0.05 AND l_returnflag = 'N' AS applied FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT s AS supplier, kind, count(*) AS n FROM d WHERE NOT (kind = 'NUMERIC_DISCOUNT' AND applied) GROUP BY ALL""")
def promotions_of_a_run(spark, sf):
    nations = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = read(spark, sf, "lineitem").select("l_suppkey", "l_discount", "l_returnflag").join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    high = F.col("l_discount") > 0.05
    one = lambda rows, kind, applied: rows.select(F.col("n_name").alias("supplier"), F.col("l_suppkey").cast("string").alias("source_reference"), F.lit(kind).alias("kind"), F.col("l_returnflag").alias("source_text"), applied.alias("already_applied"))
    found = conditions.combined(one(lines.where(high), "NUMERIC_DISCOUNT", F.col("l_returnflag") == "N"), one(lines.where(~high), "REVIEW", F.lit(False)))
    return conditions.not_in_price(found).groupBy("supplier", "kind").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 <> 0 THEN 'S' ELSE ' ' END AS s, CASE o_orderkey % 5 WHEN 0 THEN 'REVIEW' WHEN 1 THEN 'OTHER' ELSE 'NUMERIC_DISCOUNT' END AS kind, CASE WHEN o_custkey % 4 = 0 THEN 'REVIEW' ELSE 'CERTAIN' END AS c, o_orderstatus <> 'O' AS ok FROM orders)
SELECT id, CASE WHEN s = ' ' THEN 'NO_SUPPLIER' WHEN kind = 'OTHER' THEN 'KIND' END AS error, kind = 'NUMERIC_DISCOUNT' AND c <> 'REVIEW' AND ok AS affects_total, CASE WHEN kind = 'NUMERIC_DISCOUNT' THEN 0.1::DOUBLE END AS discount_rate FROM p""")
def promotion_contract(spark, sf):
    k = F.col("o_orderkey")
    yes = F.lit(True)
    p = read(spark, sf, "orders").select(k.alias("id"), F.when(k % 13 != 0, "S").otherwise(" ").alias("supplier"), F.lit("r").alias("source_reference"), F.when(k % 5 == 0, "REVIEW").when(k % 5 == 1, "OTHER").otherwise("NUMERIC_DISCOUNT").alias("kind"), F.when(F.col("o_custkey") % 4 == 0, "REVIEW").otherwise("CERTAIN").alias("certainty"), (F.col("o_orderstatus") != "O").alias("confirmed"), yes.alias("deterministic"), yes.alias("active"), yes.alias("affects_total"), yes.alias("affects_supplier_choice"), F.lit(0.1).alias("discount_rate"))
    return conditions.contract(p).select("id", "error", "affects_total", "discount_rate")


@query("""WITH p AS (SELECT p_partkey AS source_row, CASE WHEN p_size % 4 < 3 THEN 'Expo ' || p_size || '+12,5 pz ' ELSE '' END || p_name AS d, p_size, p_partkey % 6 = 0 AS other, p_size % 5 <> 0 AS usable, CASE WHEN p_partkey % 8 > 0 THEN 1 ELSE 0 END AS pieces FROM part),
s AS (SELECT *, CASE WHEN p_size % 4 = 3 THEN 'STANDARD' WHEN other OR (p_size % 4 = 1) THEN 'REJECTED' ELSE 'DISPLAY' END AS display FROM p)
SELECT source_row, display, CASE WHEN display = 'DISPLAY' THEN CAST(p_size + 12.5 AS DOUBLE) END AS declared_units, CASE WHEN display = 'DISPLAY' THEN usable AND pieces = 1 ELSE usable END AS usable,
  CASE WHEN display = 'DISPLAY' AND usable AND pieces = 0 THEN 'no pieces' WHEN NOT usable THEN 'no price' END AS unusable_reason FROM s""")
def standalone_displays(spark, sf):
    size, k = F.col("p_size"), F.col("p_partkey")
    text = F.concat(F.when(size % 4 < 3, F.concat(F.lit("Expo "), size.cast("string"), F.lit("+12,5 pz "))).otherwise(""), "p_name")
    r = read(spark, sf, "part").select(k.alias("source_row"), text.alias("description"), F.when(k % 6 == 0, "A1").otherwise("EX7").alias("supplier_code"), F.lit(None).cast("int").alias("order_multiplier"), F.when(k % 8 > 0, 1).otherwise(0).alias("pieces_per_carton"), (size % 5 != 0).alias("usable"), F.when(size % 5 == 0, "no price").alias("unusable_reason"), size)
    r = r.withColumn("description", F.when(size % 4 == 1, F.concat("description", F.lit(" ricambio"))).otherwise(F.col("description")))
    d = conditions.standalone_displays(r, r"^expo\b", exclude=r"\bricambio\b", code=r"^EX", units=r"[0-9]+\+[0-9,]+ pz")
    return doubles(d.select("source_row", "display", "declared_units", "usable", "unusable_reason"))


_ALIASES = [("ean", ["eancode", "codiceabarre"]), ("description", ["descrizione"]), ("price", ["prezzo", "cessione"]), ("order_quantity", ["ordine"])]


@query(f"""WITH h AS (SELECT p_partkey // 500 AS document, p_partkey % 500 + 1 AS col, CASE WHEN p_size = 1 THEN 'eancode' WHEN p_size = 2 AND p_partkey % 3 = 0 THEN 'prezzo' WHEN p_size = 3 THEN 'ordine' WHEN p_size = 4 AND p_partkey % 5 = 0 THEN 'descrizione' END AS token FROM part),
a(field, names) AS (VALUES {', '.join(f"('{f}', {n})" for f, n in _ALIASES)})
SELECT document, field, CAST(min(col) AS BIGINT) AS position FROM h JOIN a ON list_contains(names, token) GROUP BY document, field HAVING count(*) = 1 OR field = 'order_quantity'""")
def suggested_columns(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    header = F.when(size == 1, "EAN Code").when((size == 2) & (k % 3 == 0), "Prezzo").when(size == 3, "ordine").when((size == 4) & (k % 5 == 0), "Descrizione ")
    h = read(spark, sf, "part").select(F.floor(k / 500).alias("document"), (k % 500 + 1).alias("position"), header.alias("header"))
    return recognition.suggested_columns(h, spark.createDataFrame(_ALIASES, "field string, names array<string>"), ["document"])


@query("""WITH d AS (SELECT p_brand AS document, count(*) AS n, count(*) FILTER (WHERE p_size % 12 = 0) AS u FROM part GROUP BY 1)
SELECT document, n AS rows_read, u AS rows_usable, n - u AS rows_discarded, u >= greatest(1, n * 0.10) AS ok FROM d""")
def mapping_dry_run(spark, sf):
    r = read(spark, sf, "part").select(F.col("p_brand").alias("document"), (F.col("p_size") % 12 == 0).alias("usable"))
    return recognition.dry_run(r, ["document"], least_share=0.10)


@query("""WITH o AS (SELECT p_brand AS document, max(p_size) AS max_row, min(p_partkey) % 4 AS header_row, 'S' || min(p_partkey) % 2 AS sheet, count(*) AS width, list_distinct(flatten(list(string_split(p_name, ' ')))) AS headers FROM part GROUP BY 1)
SELECT document, list_contains(headers, 'red') AND list_contains(headers, 'gear') AND width >= 9 AS columns_ok, header_row = 1 AS header_row_ok, sheet = 'S1' AS sheet_ok, max_row >= 50 AS data_rows_ok FROM o""")
def layout_checks(spark, sf):
    p = read(spark, sf, "part")
    first = p.groupBy(F.col("p_brand").alias("document")).agg(F.max("p_size").alias("max_row"), (F.min("p_partkey") % 4).alias("header_row"), F.concat(F.lit("S"), (F.min("p_partkey") % 2).cast("string")).alias("sheet"), F.count("*").alias("max_column"))
    words = p.select(F.col("p_brand").alias("document"), F.explode(F.split("p_name", " ")).alias("w")).groupBy("document").agg(F.collect_set("w").alias("headers"))
    observed = first.join(words, "document").withColumn("adapter_id", F.lit("a"))
    declared = spark.createDataFrame([("a", ["Red", "gear"], [9, 2], 1, "s1", 50)], "adapter_id string, named array<string>, numbered array<int>, wanted_header_row long, wanted_sheet string, data_start long")
    return recognition.layout_checks(observed, declared).select("document", "columns_ok", "header_row_ok", "sheet_ok", "data_rows_ok")
