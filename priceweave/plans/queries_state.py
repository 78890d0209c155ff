"""Queries on memories in time, comparisons of states, promotions, displays, profiles and recognition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprints, numbers, text
from ..operators import aggregates, displays, history, promotions, recognition, reconcile
from .registry import doubles, query
from .tables import SQL_PRICE_LIST, SQL_REORDER, price_list, read, reorder

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _ts(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


_CHANGED = """log AS (SELECT user_id, event_type AS answer, ts, event_id, lag(event_type) OVER w AS last, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
changed AS (SELECT user_id, answer, ts, event_id FROM log WHERE n = 1 OR answer IS DISTINCT FROM last)"""


@query(f"WITH {_CHANGED} SELECT user_id, answer, {_TS.format('ts')} AS valid_from, {_TS.format('lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS valid_to FROM changed")
def scd2_confirmations(spark, sf):
    log = read(spark, sf, "events").select("user_id", F.col("event_type").alias("answer"), "ts", "event_id")
    v = history.versions(log, ["user_id"], "answer", "ts", "event_id")
    return v.select("user_id", "answer", _ts("valid_from").alias("valid_from"), _ts("valid_to").alias("valid_to"))


@query("""WITH last AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last WHERE k = 1 AND event_type = 'error')""")
def current_rejections_semi(spark, sf):
    last = history.current(read(spark, sf, "events"), ["user_id"], "ts", "event_id", "event_type")
    no = last.where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return history.without_rejected(read(spark, sf, "customer"), no, ["c_custkey"]).select("c_custkey", "c_name")


@query("""SELECT l_partkey AS identity, count(DISTINCT l_orderkey) AS n_orders, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity, strftime(min(o_orderdate), '%Y-%m-%d') AS first_created, strftime(max(o_orderdate), '%Y-%m-%d') AS last_created
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY l_partkey""")
def pending_orders_by_identity(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    lines = read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select(F.col("l_partkey").alias("identity"), F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast(numbers.MONEY).alias("quantity"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("closed").alias("status"))
    out = history.pending_by_identity(lines)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return doubles(out.select("identity", "n_orders", "quantity", day("first_created"), day("last_created")))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND greatest(o_orderdate, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 40 DAY END) < TIMESTAMP '2001-07-01' - INTERVAL 60 DAY""")
def order_expiry(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("created"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.make_interval(days=F.lit(40))).alias("answered"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("closed").alias("status"))
    return history.expired(o, F.lit("2001-07-01").cast("timestamp")).select("o_orderkey")


@query("""SELECT event_id, strftime(CASE WHEN event_id % 4 = 0 OR event_id % 3 <> 0 THEN ts + INTERVAL 7 DAY END, '%Y-%m-%d %H:%M:%S') AS ask_at FROM events WHERE event_type = 'error'""")
def ask_again(spark, sf):
    e = read(spark, sf, "events").where("event_type = 'error'")
    again = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 4 == 0, F.col("ts") - F.make_interval(days=F.lit(1))).otherwise(F.col("ts") + F.make_interval(days=F.lit(1))))
    return e.select("event_id", _ts(history.ask_again_at(F.col("ts"), again)).alias("ask_at"))


_AUDIT = "SELECT l_suppkey AS k, count(*) AS n_rows, median(l_extendedprice) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = {0} GROUP BY l_suppkey"
_OFF = "abs({0}_now - {0}_before) > {0}_before * CAST({1} AS DOUBLE)"


@query(f"""WITH a AS ({_AUDIT.format(2000)}), b AS ({_AUDIT.format(1999)}), j AS (SELECT coalesce(a.k, b.k) AS l_suppkey, a.n_rows AS rows_now, b.n_rows AS rows_before, a.price AS price_now, b.price AS price_before FROM a FULL OUTER JOIN b ON a.k = b.k)
SELECT l_suppkey, rows_now, rows_before, CASE WHEN rows_now IS NULL THEN 'vanished' WHEN rows_before IS NULL THEN 'new' WHEN {_OFF.format('rows', 0.15)} THEN 'rows' WHEN {_OFF.format('price', 0.10)} THEN 'price' ELSE 'steady' END AS verdict FROM j""")
def run_drift_full_outer(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    lines = read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    audit = lambda y: lines.where(F.col("y") == y).groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), F.median("l_extendedprice").alias("price"))
    return reconcile.run_drift(audit(2000), audit(1999), ["l_suppkey"]).select("l_suppkey", "rows_now", "rows_before", "verdict")


@query("""WITH a AS (SELECT p_partkey AS r, p_size AS v FROM part), b AS (SELECT p_partkey AS r, CASE WHEN p_partkey % 10 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 17 <> 0)
SELECT coalesce(a.r, b.r) AS row, a.v AS "left", b.v AS "right" FROM a FULL OUTER JOIN b ON a.r = b.r WHERE a.v IS DISTINCT FROM b.v""")
def cell_diff_full_outer(spark, sf):
    p = read(spark, sf, "part")
    a = p.select(F.col("p_partkey").alias("row"), F.col("p_size").alias("value"))
    b = p.where("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") % 10 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("value"))
    return reconcile.cell_diff(a, b, ["row"])


@query("""SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS at, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_document_per_role(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return history.latest_per(o, ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), "o_orderkey", "o_orderstatus")


@query("""WITH r AS (SELECT DISTINCT o_orderstatus AS s, o_orderkey AS n FROM orders), i AS (SELECT s, n, n - row_number() OVER (PARTITION BY s ORDER BY n) AS g FROM r)
SELECT s AS o_orderstatus, min(n) AS first, max(n) AS last, count(*) AS size FROM i GROUP BY s, g""")
def contiguous_ranges(spark, sf):
    return reconcile.contiguous(read(spark, sf, "orders"), ["o_orderstatus"], "o_orderkey")


@query("""WITH c AS (SELECT l_orderkey % 20 AS sheet, l_orderkey * 10 + l_linenumber AS row, count(*) AS n, max(CAST(l_quantity AS INT)) % 6 + 1 AS cells FROM lineitem GROUP BY ALL),
w AS (SELECT *, lag(cells) OVER x AS b, lead(cells) OVER x AS f FROM (SELECT sheet, row, max(cells) AS cells FROM c GROUP BY ALL) WINDOW x AS (PARTITION BY sheet ORDER BY row))
SELECT sheet, row, cells AS nonempty FROM w WHERE cells BETWEEN 1 AND 2 AND b >= 4 AND f >= 4""")
def separator_rows_lag_lead(spark, sf):
    x = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 20).alias("sheet"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.col("l_quantity").cast("int").alias("q"))
    rows = x.groupBy("sheet", "row").agg((F.max("q") % 6 + 1).alias("nonempty"))
    return reconcile.separators(rows, ["sheet"], "row").select("sheet", "row", "nonempty")


_PROFILED = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM part" for c in _PROFILED)


@query(f"""WITH l AS ({_PROFILE}), k AS (SELECT column_name, v, CASE WHEN v IS NULL OR trim(v) = '' THEN 'blank' WHEN regexp_full_match(v, '-?\\d+(\\.\\d+)?([eE][-+]?\\d+)?') THEN 'number' WHEN lower(v) IN ('true', 'false') THEN 'boolean' ELSE 'text' END AS kind FROM l)
SELECT column_name, count(*) FILTER (WHERE kind <> 'blank') AS nonempty, count(*) FILTER (WHERE kind = 'number') AS numbers, count(*) FILTER (WHERE kind = 'text') AS texts, count(*) FILTER (WHERE kind = 'boolean') AS booleans, count(DISTINCT v) AS distinct_values FROM k GROUP BY column_name""")
def column_profile(spark, sf):
    return aggregates.column_profile(read(spark, sf, "part"), _PROFILED)


_CHECKS = [("a1", "p_partkey", 10, "numbers", 0.5, 3), ("a1", "p_name", 10, "texts", 0.5, 2), ("a2", "p_size", 10, "texts", 0.5, 4), ("a2", "p_brand", 10, "texts", 0.9, 1)]


@query(f"""WITH l AS ({_PROFILE}), p AS (SELECT column_name, count(v) AS nonempty, count(*) FILTER (WHERE regexp_full_match(v, '-?\\d+(\\.\\d+)?')) AS numbers, count(*) FILTER (WHERE NOT regexp_full_match(v, '-?\\d+(\\.\\d+)?')) AS texts FROM l GROUP BY 1),
c(adapter_id, column_name, least, kind, share, weight) AS (VALUES {', '.join(map(str, _CHECKS))}),
j AS (SELECT c.*, nonempty >= least AND CASE kind WHEN 'numbers' THEN numbers ELSE texts END > nonempty * CAST(share AS DOUBLE) AS ok FROM c JOIN p USING (column_name))
SELECT adapter_id, CAST(sum(CASE WHEN ok THEN weight ELSE 0 END) AS BIGINT) AS score, count(*) FILTER (WHERE NOT ok) AS n_failed FROM j GROUP BY adapter_id""")
def shape_score(spark, sf):
    checks = spark.createDataFrame(_CHECKS, "adapter_id string, column_name string, least long, kind string, share double, weight long")
    return recognition.shape_score(aggregates.column_profile(read(spark, sf, "part"), _PROFILED), checks)


_ADAPTERS = [("by_word", ["red", "bolt", "small", "gear"]), ("by_size", ["ring", "small"]), ("by_colour", ["blue", "red", "green"])]


@query(f"""WITH d AS (SELECT p_brand AS document_id, list_distinct(flatten(list(string_split(p_name, ' ')))) AS h FROM part GROUP BY 1),
a(adapter_id, r) AS (VALUES {', '.join(f"('{i}', {r})" for i, r in _ADAPTERS)}),
m AS (SELECT document_id, adapter_id, len(r) AS n_required, CAST(len(list_intersect(h, r)) AS BIGINT) AS n_present FROM d, a)
SELECT document_id, adapter_id, CAST(n_required AS INT) AS n_required, n_present, CASE WHEN n_required = n_present THEN 'KNOWN' WHEN n_required - n_present <= 2 AND n_present >= 3 THEN 'NEAR' ELSE 'VARIED' END AS state FROM m WHERE n_present > 0""")
def schema_recognition_containment(spark, sf):
    words = read(spark, sf, "part").select(F.col("p_brand").alias("document_id"), F.explode(F.split("p_name", " ")).alias("w"))
    docs = words.groupBy("document_id").agg(F.collect_set("w").alias("headers"))
    return recognition.coverage(docs, spark.createDataFrame(_ADAPTERS, "adapter_id string, required array<string>"))


@query("SELECT unnest(range(1, (SELECT max(p_partkey) + 1 FROM part))) AS p_partkey EXCEPT SELECT p_partkey FROM part WHERE p_size % 7 <> 0")
def missing_pages_anti(spark, sf):
    part = read(spark, sf, "part")
    last = part.agg(F.max("p_partkey")).first()[0] or 0
    return reconcile.missing_numbers(part.where("p_size % 7 <> 0"), "p_partkey", last)


@query("SELECT min(p_partkey) AS p_partkey, lower(p_name) AS name, lower(p_brand) AS brand FROM part GROUP BY lower(p_name), lower(p_brand)")
def dedup_first_occurrence(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return reconcile.first_occurrence(p, ["p_name", "p_brand"], "p_partkey").select("p_partkey", F.lower("p_name").alias("name"), F.lower("p_brand").alias("brand"))


_SLICES = """p AS (SELECT page_id + 1 AS page, url, html FROM pages), n AS (SELECT max(page) AS last FROM p),
s AS (SELECT CAST(ceil(page * least(10, last) / last) - 1 AS INTEGER) AS slice, arg_min(page, md5(page || ':7')) AS page FROM p, n GROUP BY 1)"""


@query(f"WITH {_SLICES} SELECT slice, page FROM s")
def stratified_sample(spark, sf):
    return reconcile.stratified_pages(read(spark, sf, "pages").select((F.col("page_id") + 1).alias("page")), "page", 10, 7)


@query("""WITH r AS (SELECT o_orderkey, o_custkey // 10 + 1 AS page, o_orderpriority AS name, o_totalprice AS price FROM orders), n AS (SELECT max(page) AS last FROM r),
s AS (SELECT ceil(page * least(200, last) / last) AS slice, arg_min(page, md5(page || ':5')) AS page FROM r, n GROUP BY 1),
t AS (SELECT page, arg_min(o_orderkey, md5(o_orderkey || ':5')) AS o_orderkey FROM r WHERE page IN (SELECT page FROM s) GROUP BY page),
again AS (SELECT page, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE name END AS name, price FROM r WHERE o_orderkey % 11 <> 0 UNION ALL SELECT page, name, price FROM r WHERE o_orderkey % 5 = 0),
e AS (SELECT t.page, t.o_orderkey, r.name, r.price FROM t JOIN r USING (o_orderkey))
SELECT e.page, e.o_orderkey, count(a.page) AS n_rows, count(*) FILTER (WHERE a.name = e.name AND a.price = e.price) AS n_equal, CASE WHEN count(*) FILTER (WHERE a.name = e.name AND a.price = e.price) = 1 THEN 'PASS' ELSE 'FAIL' END AS outcome
FROM e LEFT JOIN again a ON a.page = e.page GROUP BY e.page, e.o_orderkey""")
def spot_checks(spark, sf):
    """A row of a page of each slice against the page as it is when it is read again: some rows changed, gone or twice."""
    o = read(spark, sf, "orders").select("o_orderkey", (F.floor(F.col("o_custkey") / 10) + 1).alias("page"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("price"))
    wanted = reconcile.targets(o, reconcile.stratified_pages(o, "page", 200, 5), "page", "o_orderkey", 5)
    key = F.col("o_orderkey")
    again = o.where(key % 11 != 0).withColumn("name", F.when(key % 7 == 0, " changed ").otherwise(F.concat(F.lit("  "), "name"))).unionByName(o.where(key % 5 == 0))
    return reconcile.spot_check(wanted, again, "page", ["name", "price"]).select("page", "o_orderkey", "n_rows", "n_equal", "outcome")


@query("""SELECT count(*) AS everything, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS ordered, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders""")
def filter_counts(spark, sf):
    s = F.col("o_orderstatus")
    return aggregates.conditional_counts(read(spark, sf, "orders"), everything=F.lit(True), pending=s == "O", ordered=s == "F", urgent=F.col("o_orderpriority") == "1-URGENT", large=F.col("o_totalprice") > 100000)


_PROMO = """texts AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Acquistando ' || p_size || ' ct tra: in omaggio 1 ct di ' || p_name WHEN 1 THEN p_size || '+1 gratis su ' || p_name WHEN 2 THEN 'Offerta ' || p_name WHEN 3 THEN p_size || '+2 ml omaggio' ELSE p_name END AS txt FROM part)"""
_FLAT = "trim(regexp_replace(upper(strip_accents(txt)), '\\s+', ' ', 'g'))"


def _promo_texts(spark, sf):
    k, n, name = F.col("p_partkey") % 5, F.col("p_size").cast("string"), F.col("p_name")
    words = F.when(k == 0, F.concat(F.lit("Acquistando "), n, F.lit(" ct tra: in omaggio 1 ct di "), name)).when(k == 1, F.concat(n, F.lit("+1 gratis su "), name)).when(k == 2, F.concat(F.lit("Offerta "), name)).when(k == 3, F.concat(n, F.lit("+2 ml omaggio"))).otherwise(name)
    return read(spark, sf, "part").select(F.col("p_partkey").alias("id"), words.alias("txt"))


@query(f"""WITH {_PROMO}, t AS (SELECT id, {_FLAT} AS t FROM texts)
SELECT id, CASE WHEN t LIKE 'ACQUISTANDO%' THEN 'THRESHOLD_GIFT' WHEN regexp_matches(t, '^\\d+\\+1 GRATIS') THEN 'INCLUDED_PACK' ELSE 'REVIEW' END AS kind,
  CASE WHEN t LIKE 'ACQUISTANDO%' THEN CAST(regexp_extract(t, 'ACQUISTANDO (\\d+)', 1) AS INT) WHEN regexp_matches(t, '^\\d+\\+1 GRATIS') THEN CAST(regexp_extract(t, '^(\\d+)', 1) AS INT) END AS threshold,
  CASE WHEN t LIKE 'ACQUISTANDO%' THEN 'CARTONS' END AS threshold_unit, CASE WHEN t LIKE 'ACQUISTANDO%' THEN regexp_extract(t, ' CT DI (.+)$', 1) END AS reward_text
FROM t WHERE regexp_matches(t, 'OMAGGIO|GRATIS|OFFERTA')""")
def promotion_regex_parse(spark, sf):
    p = _promo_texts(spark, sf).select("id", promotions.parse_text(F.col("txt")).alias("p")).where("p is not null")
    return p.select("id", "p.kind", "p.threshold", "p.threshold_unit", "p.reward_text")


_STATES = f"""WITH {SQL_PRICE_LIST}, promo AS (SELECT s_suppkey AS promotion_id, n_name AS supplier, 20 + s_suppkey * 25 AS threshold, CASE WHEN s_suppkey % 2 = 0 THEN 'CARTONS' ELSE 'PIECES' END AS unit, s_suppkey % 3 = 0 AS repeatable, 'A' AS group_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
lines AS (SELECT supplier, flag AS group_id, 1 AS cartons, pieces_per_carton AS pieces FROM price_list),
s AS (SELECT supplier, group_id, sum(cartons) AS cartons, sum(pieces) AS pieces FROM lines GROUP BY ALL),
j AS (SELECT p.*, CAST(coalesce(CASE WHEN unit = 'CARTONS' THEN cartons ELSE pieces END, 0) AS DECIMAL(18,4)) AS done FROM promo p LEFT JOIN s USING (supplier, group_id)),
states AS (SELECT promotion_id, supplier, done AS progress, greatest(threshold - done, 0) AS remaining, CASE WHEN done >= threshold THEN 'EARNED' WHEN done > 0 AND (done >= threshold * 0.8 OR threshold - done <= 1) THEN 'NEAR' ELSE 'NOT_REACHED' END AS status,
  CASE WHEN done >= threshold THEN CASE WHEN repeatable THEN CAST(floor(done / threshold) AS BIGINT) ELSE 1 END ELSE 0 END AS rewards FROM j)"""


def _states(spark, sf):
    k = F.col("s_suppkey")
    nations = read(spark, sf, "nation").select("n_nationkey", "n_name")
    promo = read(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(k.alias("promotion_id"), F.col("n_name").alias("supplier"), (20 + k * 25).alias("threshold"), F.when(k % 2 == 0, "CARTONS").otherwise("PIECES").alias("unit"), (k % 3 == 0).alias("repeatable"), F.lit("A").alias("group_id"))
    lines = price_list(spark, sf).select("supplier", F.col("flag").alias("group_id"), F.lit(1).alias("cartons"), F.col("pieces_per_carton").alias("pieces"))
    return promotions.progress(promo, lines)


@query(f"{_STATES} SELECT promotion_id, supplier, CAST(progress AS DOUBLE) AS progress, CAST(remaining AS DOUBLE) AS remaining, status, CAST(rewards AS BIGINT) AS rewards FROM states")
def threshold_gift_progress(spark, sf):
    return doubles(_states(spark, sf))


@query(f"{_STATES} SELECT supplier, count(*) FILTER (WHERE status = 'EARNED') AS earned, count(*) FILTER (WHERE status = 'NEAR') AS near, count(*) FILTER (WHERE status = 'NOT_REACHED') AS not_reached FROM states GROUP BY supplier")
def promotion_summary_pivot(spark, sf):
    return promotions.summary(_states(spark, sf))


@query("""WITH p AS (SELECT p_partkey AS product_id, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean, p_brand || p_type AS group_id FROM part),
o AS (SELECT s_suppkey AS promotion_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS product_id, CASE WHEN s_suppkey % 3 = 1 THEN lpad(CAST(s_suppkey AS VARCHAR), 13, '0') END AS ean, CASE WHEN s_suppkey % 4 = 2 THEN 'Brand#' || (s_suppkey % 25 + 1) || 'ECONOMY' END AS group_id FROM supplier)
SELECT DISTINCT promotion_id, p.product_id FROM o JOIN p ON o.product_id = p.product_id OR o.ean = p.ean OR o.group_id = p.group_id""")
def promo_eligibility_theta(spark, sf):
    pad = lambda c: F.lpad(c.cast("string"), 13, "0")
    p = read(spark, sf, "part").select(F.col("p_partkey").alias("product_id"), pad(F.col("p_partkey")).alias("ean"), F.concat("p_brand", "p_type").alias("group_id"))
    k = F.col("s_suppkey")
    o = read(spark, sf, "supplier").select(k.alias("promotion_id"), F.when(k % 3 == 0, k).alias("product_id"), F.when(k % 3 == 1, pad(k)).alias("ean"), F.when(k % 4 == 2, F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string"), F.lit("ECONOMY"))).alias("group_id"))
    return promotions.eligible_pairs(p, o)


_SHEET = "sheet AS (SELECT p_partkey // 500 AS sheet, p_partkey AS row, CASE WHEN p_size % 10 = 0 THEN 'PARENT' WHEN p_size % 10 < 7 THEN 'COMPONENT' ELSE 'STANDARD' END AS kind, CASE WHEN p_size <> 13 THEN p_size END AS quantity FROM part)"


def _sheet(spark, sf):
    s = F.col("p_size")
    return read(spark, sf, "part").select(F.floor(F.col("p_partkey") / 500).alias("sheet"), F.col("p_partkey").alias("row"), F.when(s % 10 == 0, "PARENT").when(s % 10 < 7, "COMPONENT").otherwise("STANDARD").alias("kind"), F.when(s != 13, s).alias("quantity"))


_BUNDLES = f"""WITH {_SHEET}, b AS (SELECT *, sum(CASE WHEN kind = 'COMPONENT' THEN 0 ELSE 1 END) OVER (PARTITION BY sheet ORDER BY row) AS block FROM sheet),
bundles AS (SELECT sheet, max(row) FILTER (WHERE kind = 'PARENT') AS parent_row, count(*) FILTER (WHERE kind = 'COMPONENT') AS n_components,
  CASE WHEN count(*) FILTER (WHERE kind = 'COMPONENT' AND quantity IS NULL) = 0 THEN CAST(sum(quantity) FILTER (WHERE kind = 'COMPONENT') AS BIGINT) END AS pieces, min(row) FILTER (WHERE kind = 'COMPONENT') AS first_row, max(row) FILTER (WHERE kind = 'COMPONENT') AS last_row
  FROM b GROUP BY sheet, block HAVING max(row) FILTER (WHERE kind = 'PARENT') IS NOT NULL AND count(*) FILTER (WHERE kind = 'COMPONENT') >= 2)"""


@query(f"{_BUNDLES} SELECT * FROM bundles")
def bundle_islands(spark, sf):
    return displays.bundles(_sheet(spark, sf), ["sheet"], "row")


@query(f"""{_BUNDLES}, e AS (SELECT sheet, parent_row, CAST(CASE WHEN parent_row % 2 = 0 THEN 4 ELSE 0 END - CASE WHEN parent_row % 7 = 0 THEN 10 ELSE 0 END + 2 + CASE WHEN parent_row % 3 = 0 THEN 1 ELSE 0 END + 1 + CASE WHEN n_components >= 2 THEN 1 ELSE 0 END + CASE WHEN coalesce(pieces = 50, false) THEN 2 ELSE 0 END + CASE WHEN coalesce(pieces = n_components * 20, false) THEN 1 ELSE 0 END + CASE WHEN parent_row % 5 = 0 THEN 2 ELSE 0 END AS INT) AS score, n_components FROM bundles)
SELECT sheet, parent_row, score, CASE WHEN parent_row % 2 = 0 AND parent_row % 7 <> 0 AND score >= 10 THEN 'HIGH' WHEN parent_row % 2 = 0 AND parent_row % 7 <> 0 AND score >= 7 THEN 'MEDIUM' ELSE 'NONE' END AS verdict FROM e""")
def bundle_evidence_score(spark, sf):
    b = displays.bundles(_sheet(spark, sf), ["sheet"], "row")
    r, n = F.col("parent_row"), F.col("n_components")
    term, negated = r % 2 == 0, r % 7 == 0
    score = displays.evidence(term, negated, r % 3 == 0, F.lit(False), n, F.lit(50), F.col("pieces"), n * 20, r % 5 == 0)
    return b.select("sheet", "parent_row", score.alias("score"), n.alias("n")).select("sheet", "parent_row", "score", displays.verdict(F.col("score"), term, negated, F.col("n")).alias("verdict"))


@query("""WITH q AS (SELECT l_orderkey AS k, CAST(l_partkey % 4 AS VARCHAR) AS i, CASE WHEN count(l_quantity) = count(*) THEN sum(CAST(l_quantity AS BIGINT)) END AS q FROM (SELECT l_orderkey, l_partkey, CASE WHEN l_quantity <> 7 THEN l_quantity END AS l_quantity FROM lineitem) GROUP BY ALL)
SELECT k AS l_orderkey, sha256(string_agg(i || ':' || coalesce(CAST(q AS VARCHAR), '?'), chr(31) ORDER BY i)) AS fingerprint, count(*) AS n_parts, CASE WHEN count(q) = count(*) THEN CAST(sum(q) AS BIGINT) END AS pieces FROM q GROUP BY k""")
def composition_fingerprint_groups(spark, sf):
    x = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 4).cast("string").alias("ean"), F.lit("").alias("description"), F.when(F.col("l_quantity") != 7, F.col("l_quantity").cast("long")).alias("quantity"))
    return displays.compositions(x, ["l_orderkey"])


@query(f"""WITH {SQL_REORDER} SELECT source_row, 'S|' || ean || '|' || brand || '|' || trim(regexp_replace(upper(strip_accents(description)), '[^A-Z0-9]+', ' ', 'g')) AS article, ean || '|' || trim(regexp_replace(upper(strip_accents(description)), '[^A-Z0-9]+', ' ', 'g')) AS product FROM reorder""")
def identities(spark, sf):
    return reorder(spark, sf).select("source_row", fingerprints.article(F.lit("S"), F.col("ean"), F.col("brand"), F.col("description")).alias("article"), fingerprints.product(F.col("ean"), F.col("description")).alias("product"))


@query("""SELECT doc_id, trim(regexp_replace(upper(strip_accents(replace(text, 'ß', 'ss'))), '[^A-Z0-9.,]+', ' ', 'g')) AS matching FROM documents""")
def folded_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.matching_text(F.col("text")).alias("matching"))


@query(f"""WITH {SQL_REORDER}, d AS (SELECT source_row, [CAST(x AS INT) FOR x IN string_split(ean, '')] AS f FROM reorder) SELECT source_row, (list_sum([f[i] * CASE WHEN (13 - i) % 2 = 1 THEN 3 ELSE 1 END FOR i IN range(1, 14)]) % 10) = 0 AS valid FROM d""")
def gtin_check(spark, sf):
    return reorder(spark, sf).select("source_row", numbers.gtin_valid(F.col("ean")).alias("valid"))


@query("SELECT p_partkey, CAST(round_even(p_retailprice / 100, 0) AS INT) AS cartons FROM part")
def suggested_quantities(spark, sf):
    return read(spark, sf, "part").select("p_partkey", numbers.suggested_quantity(F.col("p_retailprice") / 100).alias("cartons"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM s GROUP BY user_id, k""")
def session_gaps(spark, sf):
    s = history.sessions(read(spark, sf, "events").select("user_id", "ts"), "user_id", "ts", "6 hours")
    return s.select("user_id", _ts("started").alias("started"), _ts("ended").alias("ended"), "n")
