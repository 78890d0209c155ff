"""Queries of the run's accounting over the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger
from .registry import doubles, query
from .tables import SQL_PRICE_LIST, SQL_REORDER, price_list, read, reorder

_SHORT = f"""WITH {SQL_REORDER}, {SQL_PRICE_LIST}, short AS (SELECT r.source_row AS qid, p.supplier, p.source_row AS iid, CAST(p.discount_rate AS DOUBLE) * 10 AS score FROM reorder r JOIN price_list p ON p.ean = r.ean)"""


def _short(spark, sf):
    r = reorder(spark, sf).select(F.col("source_row").alias("qid"), "ean")
    p = price_list(spark, sf).select("supplier", F.col("source_row").alias("iid"), "ean", (F.col("discount_rate").cast("double") * 10).alias("score"))
    return r.join(p, "ean").select("qid", "supplier", "iid", "score")


@query("""SELECT l_shipmode AS supplier, l_returnflag AS kind, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS n_price FROM (SELECT CAST(l_suppkey AS VARCHAR) AS l_shipmode, l_returnflag, l_discount FROM lineitem) GROUP BY ALL""")
def warnings_by_class(spark, sf):
    w = read(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("supplier"), F.concat("l_returnflag", F.lit(": row "), F.col("l_orderkey").cast("string")).alias("text"), (F.col("l_discount") > 0.05).alias("affects_price"))
    return ledger.warnings_summary(w)


@query("""WITH s AS (SELECT p_brand, list(p_partkey ORDER BY p_partkey) AS r FROM part GROUP BY 1)
SELECT p_brand, array_to_string(r[1:6], ', ') || CASE WHEN len(r) > 6 THEN ' +' || (len(r) - 6) ELSE '' END AS rows FROM s""")
def cited_rows(spark, sf):
    s = read(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("r"))
    return s.select("p_brand", ledger.cited_rows(F.col("r")).alias("rows"))


@query("""SELECT o_orderpriority AS supplier, count(*) AS n_read, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_in_price, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_totalprice > 100000) AS n_actionable, count(*) FILTER (WHERE o_custkey % 10 = 0) AS n_unlinked FROM orders GROUP BY 1""")
def promotion_supplier_counts(spark, sf):
    p = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("supplier"), (F.col("o_orderstatus") == "F").alias("applied"), (F.col("o_totalprice") > 100000).alias("actionable"), (F.col("o_custkey") % 10).alias("n_products"))
    return ledger.promotion_counts(p)


@query("SELECT l_suppkey AS supplier, l_partkey AS row, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL")
def destination_rows(spark, sf):
    return ledger.destination_rows(read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("row"), F.col("l_quantity").cast("long").alias("quantity")))


@query(f"{_SHORT} SELECT qid, supplier, max(score) AS best_score, count(*) AS n_candidates FROM short GROUP BY ALL")
def best_case_scores(spark, sf):
    return ledger.case_scores(_short(spark, sf))


@query(f"{_SHORT} SELECT qid, supplier, max(score) AS best_score FROM short WHERE qid % 2 = 1 GROUP BY ALL HAVING max(score) >= 0.65")
def suspicious_rejects(spark, sf):
    short = _short(spark, sf)
    decisions = short.select("qid", "supplier", F.when(F.col("qid") % 2 == 1, "REJECT").otherwise("ACCEPT").alias("action")).distinct()
    return ledger.suspicious_rejects(decisions, ledger.case_scores(short))


@query("""WITH c AS (SELECT event_id % 4 AS n, CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'error' THEN 'REJECT' WHEN 'view' THEN 'UNRESOLVED' END AS a, value < 1 AS f FROM events)
SELECT count(*) AS n_cases, count(*) FILTER (WHERE n = 0) AS n_without, count(*) FILTER (WHERE n > 0 AND a = 'ACCEPT') AS n_accept, count(*) FILTER (WHERE n > 0 AND a = 'REJECT') AS n_reject, count(*) FILTER (WHERE n > 0 AND a = 'UNRESOLVED') AS n_unresolved,
  count(*) FILTER (WHERE n > 0 AND a IS NULL) AS n_undecided, count(*) FILTER (WHERE f) * 2 > count(*) AS degraded FROM c""")
def phase_report(spark, sf):
    t = F.col("event_type")
    action = F.when(t == "click", "ACCEPT").when(t == "error", "REJECT").when(t == "view", "UNRESOLVED")
    return ledger.phase_report(read(spark, sf, "events").select((F.col("event_id") % 4).alias("n_candidates"), action.alias("action"), (F.col("value") < 1).alias("failed")))


@query(f"""WITH {SQL_REORDER}, {SQL_PRICE_LIST}, o AS (SELECT ean, count(*) FILTER (WHERE usable) AS n, count(*) FILTER (WHERE status = 'F') AS odd FROM price_list GROUP BY 1),
p AS (SELECT coalesce(n, 0) AS n, coalesce(odd, 0) AS odd, suggested_cartons - 10 AS q FROM reorder LEFT JOIN o USING (ean))
SELECT count(*) FILTER (WHERE n = 0) AS n_without, count(*) FILTER (WHERE n = 0 AND q > 0) AS n_without_wanted, count(*) FILTER (WHERE odd > 0) AS n_suspicious, count(*) FILTER (WHERE odd > 0 AND q > 0) AS n_suspicious_wanted FROM p""")
def product_warnings(spark, sf):
    o = price_list(spark, sf).groupBy("ean").agg(F.count_if("usable").alias("n"), F.count_if(F.col("status") == "F").alias("odd"))
    p = reorder(spark, sf).join(o, "ean", "left").select(F.coalesce("n", F.lit(0)).alias("n_offers"), F.coalesce("odd", F.lit(0)).alias("n_suspicious"), (F.col("suggested_cartons") - 10).alias("quantity"))
    return ledger.product_warnings(p)


@query("""WITH s AS (SELECT n_name AS supplier FROM nation UNION SELECT r_name FROM region)
SELECT supplier, CAST(row_number() OVER (ORDER BY CASE supplier WHEN 'NATION_7' THEN 1 WHEN 'NATION_3' THEN 2 ELSE 3 END, supplier) AS INT) AS position FROM s""")
def supplier_order(spark, sf):
    n, r = read(spark, sf, "nation").select(F.col("n_name").alias("supplier")), read(spark, sf, "region").select(F.col("r_name").alias("supplier"))
    return ledger.supplier_order(n, r, preferred=["NATION_7", "NATION_3"])


@query("SELECT c_nationkey AS supplier, count(*) AS n_rows FROM customer GROUP BY 1 HAVING median(c_acctbal - 4500) <= 0")
def unpriced_suppliers(spark, sf):
    return ledger.unpriced_suppliers(read(spark, sf, "customer").select(F.col("c_nationkey").alias("supplier"), (F.col("c_acctbal") - 4500).alias("price")))


@query("""WITH d AS (SELECT p_brand, list_distinct(flatten(list(string_split(p_name, ' ')))) AS h FROM part GROUP BY 1)
SELECT p_brand, array_to_string(list_sort([x FOR x IN h IF NOT list_contains(['red', 'bolt', 'blue', 'ring'], x)]), ' ') AS unknown, array_to_string(list_sort([x FOR x IN ['red', 'anvil', 'zinc'] IF NOT list_contains(h, x)]), ' ') AS missing FROM d""")
def header_differences(spark, sf):
    d = read(spark, sf, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).groupBy("p_brand").agg(F.collect_set("w").alias("h"))
    lit = lambda *x: F.array(*[F.lit(v) for v in x])
    x = d.select("p_brand", ledger.header_differences(F.col("h"), lit("red", "anvil", "zinc"), lit("red", "bolt", "blue", "ring")).alias("x"))
    return x.select("p_brand", F.array_join("x.unknown", " ").alias("unknown"), F.array_join("x.missing", " ").alias("missing"))


@query("""WITH c AS (SELECT l_partkey AS qid, l_suppkey AS supplier, count(*) > 1 AS repeated FROM lineitem GROUP BY ALL), s AS (SELECT l_partkey AS qid, l_suppkey AS supplier, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
SELECT qid, supplier, coalesce(n, 0) AS n_candidates, repeated FROM c LEFT JOIN s USING (qid, supplier)""")
def split_cases(spark, sf):
    x = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("qid"), F.col("l_suppkey").alias("supplier"), "l_returnflag")
    return ledger.split_cases(x, x.where("l_returnflag = 'A'"))


@query("SELECT o_orderstatus AS model, o_orderpriority AS prompt, count(*) AS n FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') GROUP BY ALL")
def other_provenance(spark, sf):
    return ledger.other_provenance(read(spark, sf, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_orderpriority").alias("prompt")), "O", "1-URGENT")


@query("""WITH f AS (SELECT l_orderkey AS k, count(*) AS found FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS k, o_orderkey % 5 + 1 AS declared FROM orders)
SELECT k, declared, found FROM d FULL JOIN f USING (k) WHERE declared IS DISTINCT FROM found""")
def count_differences(spark, sf):
    declared = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 5 + 1).alias("declared"))
    return ledger.count_differences(declared, read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


_MANIFEST = "m AS (SELECT c_name AS file, CASE WHEN c_custkey % 70 = 1 THEN 'MASTER' ELSE 'LIST' END AS role, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 140 AS VARCHAR) END AS supplier, CAST(c_nationkey AS VARCHAR) AS declared, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE CAST(c_nationkey AS VARCHAR) END AS sha, c_custkey % 13 <> 0 AS mapped FROM customer)"


@query(f"""WITH {_MANIFEST} SELECT CASE WHEN n = 0 THEN 'NO_MASTER' ELSE 'SEVERAL_MASTERS' END AS code, NULL AS file FROM (SELECT count(*) AS n FROM m WHERE role = 'MASTER') WHERE n <> 1
UNION ALL SELECT 'SUPPLIER_TWICE', max(file) FROM m WHERE supplier IS NOT NULL GROUP BY supplier HAVING count(*) > 1 UNION ALL SELECT 'CHANGED', file FROM m WHERE sha <> declared UNION ALL SELECT 'UNMAPPED', file FROM m WHERE NOT mapped""")
def manifest_errors(spark, sf):
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    m = read(spark, sf, "customer").select(F.col("c_name").alias("file"), F.when(k % 70 == 1, "MASTER").otherwise("LIST").alias("role"), F.when(k % 3 != 0, (k % 140).cast("string")).alias("supplier"), nation.alias("declared_sha"), F.when(k % 11 == 0, "x").otherwise(nation).alias("sha"), (k % 13 != 0).alias("mapped"))
    return ledger.manifest_errors(m)


@query("SELECT l_partkey AS source_row, l_suppkey AS supplier, CASE WHEN count(DISTINCT l_orderkey) = 1 THEN min(l_orderkey) END AS row FROM lineitem GROUP BY ALL")
def only_candidate_row(spark, sf):
    return ledger.only_row(read(spark, sf, "lineitem").select(F.col("l_partkey").alias("source_row"), F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("row")))


@query(f"WITH {SQL_PRICE_LIST} SELECT supplier, count(*) AS n_lines, CAST(round(sum(CAST(unit_price_net AS DECIMAL(28,4))), 2) AS DOUBLE) AS total FROM price_list GROUP BY supplier")
def order_history_totals(spark, sf):
    return doubles(ledger.order_totals(price_list(spark, sf).select("supplier", F.col("unit_price_net").cast("decimal(28,4)").alias("amount"))))


_PLAN = """h AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 2 = 0 THEN 'now' ELSE 'old' END AS run, o_orderpriority AS s, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'received' ELSE 'expired' END AS st, o_totalprice AS t, o_orderdate AS c FROM orders WHERE o_orderkey % 3 <> 0),
p AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'now' AS run, upper(o_orderpriority) AS s, o_totalprice + 1 AS t, TIMESTAMP '2030-01-01' AS c FROM orders WHERE o_orderkey % 2 = 0 AND o_orderpriority NOT LIKE '5%' AND o_orderpriority NOT LIKE '3%'),
d AS (SELECT DISTINCT lower(o_orderpriority) AS s FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%')"""


@query(f"""WITH {_PLAN}, known AS (SELECT * FROM p WHERE lower(s) IN (SELECT s FROM d))
SELECT id AS order_id, run AS run_id, s AS supplier, st AS status, t AS total, c AS created_at FROM h WHERE id NOT IN (SELECT id FROM known) AND NOT (run = 'now' AND st = 'pending' AND lower(s) IN (SELECT s FROM d))
UNION ALL SELECT k.id, k.run, k.s, coalesce(h.st, 'pending'), k.t, coalesce(h.c, k.c) FROM known k LEFT JOIN h ON h.id = k.id""")
def recorded_plan(spark, sf):
    o = read(spark, sf, "orders")
    key, s = F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_orderstatus")
    status = F.when(s == "O", "pending").when(s == "F", "received").otherwise("expired")
    h = o.where("o_orderkey % 3 <> 0").select(key, F.when(F.col("o_custkey") % 2 == 0, "now").otherwise("old").alias("run_id"), F.col("o_orderpriority").alias("supplier"), status.alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("created_at"))
    first = F.substring("o_orderpriority", 1, 1)
    p = o.where(F.col("o_orderkey") % 2 == 0).where(~first.isin("3", "5")).select(key, F.lit("now").alias("run_id"), F.upper("o_orderpriority").alias("supplier"), F.lit("pending").alias("status"), (F.col("o_totalprice") + 1).alias("total"), F.to_timestamp(F.lit("2030-01-01")).cast(o.schema["o_orderdate"].dataType).alias("created_at"))
    return ledger.record_plan(h, p, "now", o.where(first.isin("1", "2", "3")).select(F.lower("o_orderpriority").alias("supplier")))


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'expired' ELSE 'received' END AS st, CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS yes FROM orders)
SELECT o_orderkey, CASE WHEN yes THEN 'received' WHEN st = 'expired' THEN 'expired' WHEN NOT yes THEN 'pending' ELSE st END AS answered, 'closed' AS closed FROM s""")
def order_transitions(spark, sf):
    s, k = F.col("o_orderstatus"), F.col("o_custkey") % 3
    st = F.when(s == "O", "pending").when(s == "F", "expired").otherwise("received")
    yes = F.when(k == 0, F.lit(True)).when(k == 1, F.lit(False))
    return read(spark, sf, "orders").select("o_orderkey", ledger.answered_status(st, yes).alias("answered"), ledger.closed_status(st).alias("closed"))


@query("SELECT (o_custkey % 30) || ':' || o_orderkey AS order_id FROM orders WHERE o_custkey % 30 <> 2")
def removed_compilation(spark, sf):
    ids = F.concat((F.col("o_custkey") % 30).cast("string"), F.lit(":"), F.col("o_orderkey").cast("string"))
    return ledger.without_compilation(read(spark, sf, "orders").select(ids.alias("order_id")), " 2 ")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1999-06-01' - INTERVAL 30 DAY AND o_orderdate <= TIMESTAMP '1999-06-01'")
def expired_lately(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "expired").otherwise("pending").alias("status"), F.col("o_orderdate").alias("expired_at"))
    return ledger.expired_lately(o, F.lit("1999-06-01").cast("timestamp")).select("o_orderkey")


@query("SELECT doc_id, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_line FROM (SELECT doc_id, source, len(string_split(text, chr(10))) AS n FROM documents)")
def record_lines(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", F.size(F.split("text", "\n")).cast("long").alias("n"))
    return ledger.line_numbers(d, "source", "n", "doc_id").select("doc_id", "first_line")


@query("""SELECT p_partkey AS source_row, CASE WHEN p_size % 5 = 0 THEN 'DISPLAY' WHEN p_size % 5 = 1 THEN 'COMPONENT' ELSE 'STANDARD' END AS row_type,
  CASE WHEN p_size % 5 = 0 AND p_size % 7 <> 0 THEN CAST(CAST(p_retailprice AS DECIMAL(18,4)) * p_size AS DOUBLE) END AS display_price, p_size % 5 <> 1 AND NOT (p_size % 5 = 0 AND p_size % 7 = 0) AS usable, p_size % 5 = 0 AND p_size % 3 = 0 AS reconciled FROM part""")
def records_with_displays(spark, sf):
    p, size = read(spark, sf, "part"), F.col("p_size")
    records = p.select(F.col("p_partkey").alias("source_row"), F.col("p_retailprice").cast("decimal(18,4)").alias("unit_price"), F.when(size % 7 != 0, size).alias("pack"), F.lit(True).alias("usable"))
    classes = p.where("p_size % 5 < 2").select(F.col("p_partkey").alias("source_row"), F.when(size % 5 == 0, "DISPLAY").otherwise("COMPONENT").alias("row_type"), ((size % 5 == 0) & (size % 3 == 0)).alias("reconciled"))
    return doubles(ledger.with_displays(records, classes))


@query("""WITH x AS (SELECT p_partkey, p_size, CAST(p_retailprice AS DECIMAL(18,4)) AS price FROM part)
SELECT p_partkey, CAST(price * p_size AS DOUBLE) AS pre, CAST(CAST(price * p_size AS DECIMAL(18,4)) * CAST(0.75 AS DECIMAL(9,4)) AS DECIMAL(18,4))::DOUBLE AS post, CAST(CASE WHEN p_size % 4 > 0 THEN p_size * 12 ELSE 0 END AS DOUBLE) AS pieces, CAST(ceil(p_size * 5 / 12.0) AS BIGINT) AS cartons FROM x""")
def component_amounts(spark, sf):
    size, price = F.col("p_size"), F.col("p_retailprice").cast("decimal(18,4)")
    e = ledger.component_economics(size, price, F.lit(0.25).cast("decimal(9,4)"))
    a = ledger.order_amount(F.when(size % 4 > 0, size).otherwise(0), F.lit(12), price, F.lit(None).cast("decimal(18,4)"))
    x = read(spark, sf, "part").select("p_partkey", e.alias("e"), a.alias("a"), ledger.cartons_for(size * 5, F.lit(12)).alias("cartons"))
    return doubles(x.select("p_partkey", "e.pre", "e.post", "a.pieces", "cartons"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(TRY_CAST(replace(CAST(round(value, 2) AS VARCHAR), ',', '.') AS DECIMAL(18,6)) AS DOUBLE) AS price FROM events""")
def parsed_moments(spark, sf):
    e = read(spark, sf, "events")
    written = F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    price = ledger.comparable_price(F.replace(F.round("value", 2).cast("string"), F.lit("."), F.lit(",")))
    return doubles(e.select("event_id", F.date_format(ledger.moment(written), "yyyy-MM-dd HH:mm:ss").alias("at"), price.alias("price")))


@query("""WITH x AS (SELECT p_partkey, p_name, p_size % 4 AS k, CAST(p_size % 28 + 1 AS VARCHAR) AS d, year(current_date) AS y FROM part)
SELECT p_partkey, p_name || CASE k WHEN 0 THEN '' ELSE ' new' END AS text, CASE k WHEN 1 THEN '<br> Scadenza ' || d || '/4/' || (y + 1) WHEN 2 THEN '<br> Scadenza 3/4/' || (y + 40) WHEN 3 THEN '<br> Scadenza 31/2/' || (y + 1) END AS raw,
  CASE k WHEN 1 THEN (y + 1) || '-04-' || lpad(d, 2, '0') WHEN 2 THEN (y + 40) || '-04-03' END AS expires, CASE k WHEN 1 THEN true WHEN 0 THEN NULL ELSE false END AS plausible FROM x""")
def expiry_dates(spark, sf):
    k, year = F.col("p_size") % 4, F.year(F.current_date())
    in_years = lambda n: (year + n).cast("string")
    date = F.when(k == 1, F.concat((F.col("p_size") % 28 + 1).cast("string"), F.lit("/4/"), in_years(1))).when(k == 2, F.concat(F.lit("3/4/"), in_years(40))).when(k == 3, F.concat(F.lit("31/2/"), in_years(1)))
    text = F.when(k == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" <br> Scadenza "), date, F.lit(" new")))
    # the fragment takes the space before it, so what stood behind follows at once
    x = read(spark, sf, "part").select("p_partkey", ledger.expiry_of(text, r"\s*<br>\s*SCADENZA\s*(\d{1,2})/(\d{1,2})/(\d{2,4})", year).alias("x"))
    return x.select("p_partkey", "x.text", "x.raw", F.col("x.expires").cast("string").alias("expires"), "x.plausible")


@query("""WITH d AS (SELECT p_brand AS supplier, CASE WHEN p_size > 45 THEN p_name END AS name FROM part)
SELECT supplier, coalesce(arg_min(name, {'a': length(name), 'b': name}) FILTER (WHERE name IS NOT NULL), supplier) AS name FROM d GROUP BY supplier""")
def display_names(spark, sf):
    return ledger.display_names(read(spark, sf, "part").select(F.col("p_brand").alias("supplier"), F.when(F.col("p_size") > 45, F.col("p_name")).alias("name")))


@query("""SELECT s_suppkey AS supplier, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 100 ELSE 0 END AS DOUBLE) AS minimum FROM supplier""")
def minimum_orders(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"))
    return doubles(ledger.minimum_order(s, s.where("supplier % 3 = 0").withColumn("minimum", F.lit(100).cast("decimal(18,4)"))))
