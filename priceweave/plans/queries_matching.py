"""Queries on matching, sources and offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprints, numbers, text
from ..functions.similarity import pack_attributes
from ..operators import aggregates, matching, offers, similar
from .registry import doubles, query
from .tables import SQL_PRICE_LIST, SQL_REORDER, price_list, read, reorder

_BY_CODE = """by_code AS (
  SELECT supplier, ean, count(*) AS n, count(*) FILTER (WHERE usable) AS n_usable, min(source_row) FILTER (WHERE usable) AS only_row
  FROM price_list GROUP BY ALL)"""
_STATUS = "CASE WHEN coalesce(n_usable, 0) = 1 THEN 'EXACT' WHEN coalesce(n_usable, 0) > 1 THEN 'AMBIGUOUS' WHEN coalesce(n, 0) > 0 THEN 'PRESENT_UNUSABLE' ELSE 'ABSENT' END"
_MATRIX = f"""matrix AS (
  SELECT r.source_row, r.ean, s.supplier, {_STATUS} AS status, coalesce(n, 0) AS n_candidates, coalesce(n_usable, 0) AS n_usable,
         CASE WHEN n_usable = 1 THEN only_row END AS selected_row
  FROM reorder r CROSS JOIN (SELECT DISTINCT supplier FROM price_list) s LEFT JOIN by_code b ON b.supplier = s.supplier AND b.ean = r.ean)"""
_BASE = f"WITH {SQL_REORDER}, {SQL_PRICE_LIST}, {_BY_CODE}, {_MATRIX}"
_OFFERS = """offers AS (
  SELECT m.source_row, m.ean, m.supplier, m.status, b.unit_price_net AS unit_price, b.pieces_per_carton AS pieces, b.source_row AS offer_row,
         CAST(b.unit_price_net * b.pieces_per_carton AS DECIMAL(18,4)) AS order_price
  FROM matrix m JOIN (
    SELECT *, row_number() OVER (PARTITION BY supplier, ean ORDER BY unit_price_net, pieces_per_carton, source_row) AS k
    FROM price_list WHERE usable AND unit_price_net > 0 AND pieces_per_carton > 0) b
    ON b.k = 1 AND b.supplier = m.supplier AND b.ean = m.ean WHERE m.n_usable > 0)"""
_CHEAPEST = """cheapest AS (
  SELECT source_row, supplier, unit_price, pieces, order_price, n_offers FROM (
    SELECT *, count(*) OVER (PARTITION BY source_row) AS n_offers,
           row_number() OVER (PARTITION BY source_row ORDER BY unit_price, supplier, pieces, order_price) AS k FROM offers) WHERE k = 1)"""
_D = "CAST({0} AS DOUBLE) AS {0}"


def _matrix(spark, sf, wanted=None):
    prices = price_list(spark, sf)
    nations = read(spark, sf, "nation").select(F.col("n_name").alias("supplier"), "n_nationkey")
    there = read(spark, sf, "supplier").select("s_nationkey").distinct()
    suppliers = nations.join(there, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select("supplier")
    return matching.match_matrix(reorder(spark, sf) if wanted is None else wanted, prices, suppliers)


def _offers(spark, sf):
    return offers.offers_of(reorder(spark, sf), price_list(spark, sf))


@query(f"{_BASE}, {_OFFERS}, {_CHEAPEST} SELECT source_row, supplier, {_D.format('unit_price')}, {_D.format('pieces')}, {_D.format('order_price')}, n_offers FROM cheapest")
def cheapest_offer(spark, sf):
    return doubles(offers.cheapest(_offers(spark, sf)))


@query(f"{_BASE} SELECT source_row, ean, supplier, status, n_candidates, n_usable, selected_row FROM matrix")
def match_status_matrix(spark, sf):
    return _matrix(spark, sf)


@query(f"{_BASE} SELECT status, count(*) AS n FROM matrix GROUP BY status")
def match_status_counts(spark, sf):
    return _matrix(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""{_BASE} SELECT supplier, count(*) FILTER (WHERE status = 'EXACT') AS exact, count(*) FILTER (WHERE status = 'AMBIGUOUS') AS ambiguous,
  count(*) FILTER (WHERE status = 'PRESENT_UNUSABLE') AS present_unusable, count(*) FILTER (WHERE status = 'ABSENT') AS absent FROM matrix GROUP BY supplier""")
def match_audit(spark, sf):
    return aggregates.match_audit(_matrix(spark, sf))


#: Products of the reorder list, and of a catalogue that no supplier of the lists has.
_WIDER = _BASE.replace("FROM reorder r", "FROM (SELECT source_row, ean FROM reorder UNION ALL SELECT 1000000000 + c_custkey, '9' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') FROM customer) r")


def _wider(spark, sf):
    key = F.col("c_custkey")
    other = read(spark, sf, "customer").select((key + 1_000_000_000).alias("source_row"), F.concat(F.lit("9"), F.lpad(key.cast("string"), 12, "0")).alias("ean"))
    return _matrix(spark, sf, reorder(spark, sf).select("source_row", "ean").unionByName(other))


@query(f"{_WIDER} SELECT source_row FROM matrix GROUP BY source_row HAVING bool_and(status = 'ABSENT')")
def missing_everywhere(spark, sf):
    return aggregates.missing_everywhere(_wider(spark, sf))


@query(f"""WITH {SQL_PRICE_LIST}, c AS (SELECT supplier, ean, count(*) AS n FROM price_list GROUP BY ALL)
SELECT supplier, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n) FILTER (WHERE ean <> '') AS BIGINT) AS n_with_ean, count(*) FILTER (WHERE ean <> '') AS n_eans, count(*) FILTER (WHERE n > 1) AS n_repeated FROM c GROUP BY supplier""")
def source_stats(spark, sf):
    return aggregates.source_stats(price_list(spark, sf))


@query(f"WITH {SQL_PRICE_LIST} SELECT supplier, count(*) AS n_prices, median(CAST(unit_price_net AS DOUBLE)) AS median_price FROM price_list WHERE unit_price_net > 0 GROUP BY supplier")
def price_median_by_supplier(spark, sf):
    return aggregates.price_stats(price_list(spark, sf))


@query(f"""WITH {SQL_PRICE_LIST} SELECT CASE WHEN unit_price_net IS NULL OR unit_price_net <= 0 THEN 'no price' WHEN pieces_per_carton IS NULL OR pieces_per_carton <= 0 THEN 'no pieces' WHEN flag = 'R' THEN 'not available' ELSE 'undeclared' END AS reason, count(*) AS n FROM price_list WHERE NOT usable GROUP BY reason""")
def unusable_reasons(spark, sf):
    reason = F.when(F.coalesce(F.col("unit_price_net") <= 0, F.lit(True)), "no price").when(F.coalesce(F.col("pieces_per_carton") <= 0, F.lit(True)), "no pieces").when(F.col("flag") == "R", "not available")
    return aggregates.unusable_reasons(price_list(spark, sf), reason)


_RULES = "CASE WHEN p_type LIKE 'ECON%' THEN 'economy' WHEN p_size > 40 THEN 'large' WHEN p_brand = 'Brand#11' THEN 'brand' ELSE 'kept' END"


@query(f"SELECT {_RULES} AS label, count(*) AS n FROM part GROUP BY label")
def row_filter_exclude(spark, sf):
    rules = [("economy", F.col("p_type").startswith("ECON")), ("large", F.col("p_size") > 40), ("brand", F.col("p_brand") == "Brand#11")]
    return aggregates.excluded_counts(read(spark, sf, "part"), rules)


@query("""SELECT count(*) AS n_read, count(*) FILTER (WHERE l_quantity > 0) AS n_with_pieces, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned,
  count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity > 0) AS n_orderable FROM lineitem""")
def reading_report(spark, sf):
    flag, n = F.col("l_returnflag"), F.col("l_quantity")
    return aggregates.conditional_counts(read(spark, sf, "lineitem"), n_read=F.lit(True), n_with_pieces=n > 0, n_returned=flag == "R", n_orderable=(flag != "R") & (n > 0))


@query(f"WITH {SQL_PRICE_LIST} SELECT supplier, source_row, ean, CAST(unit_price_net AS DOUBLE) AS unit_price_net, CAST(CAST(unit_price_net * pieces_per_carton AS DECIMAL(18,4)) AS DOUBLE) AS order_price FROM price_list WHERE usable")
def net_price_projection(spark, sf):
    p = price_list(spark, sf).where("usable")
    return doubles(p.select("supplier", "source_row", "ean", "unit_price_net", numbers.order_price(F.col("unit_price_net"), F.col("pieces_per_carton")).alias("order_price")))


# edges between products of equal brand, name and size
_EDGES = """edges AS (SELECT lpad(CAST(a.p_partkey AS VARCHAR), 13, '0') AS a, lpad(CAST(b.p_partkey AS VARCHAR), 13, '0') AS b
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND b.p_size = a.p_size)"""
_CLASSES = """both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (
  SELECT a AS code, a AS other FROM both_ways UNION SELECT r.code, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
classes AS (SELECT code, min(other) AS class FROM reach GROUP BY code)"""


def _classes(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    same = ["p_brand", "p_name", "p_size"]
    # an edge to the first of its equals for each product says as much as all pairs
    first = p.groupBy(*same).agg(F.min("p_partkey").alias("first"))
    ean = lambda c: F.lpad(F.col(c).cast("string"), 13, "0")
    edges = p.join(first, same).where(F.col("p_partkey") > F.col("first")).select(ean("first").alias("a"), ean("p_partkey").alias("b"))
    return matching.equivalence_classes(edges)


@query(f"WITH RECURSIVE {_EDGES}, {_CLASSES} SELECT code, class FROM classes")
def equivalence_closure(spark, sf):
    return _classes(spark, sf)


@query(f"""WITH RECURSIVE {SQL_REORDER}, {SQL_PRICE_LIST}, {_BY_CODE}, {_EDGES}, {_CLASSES},
found AS (SELECT r.source_row, b.supplier, b.n, b.n_usable, 0 AS via FROM reorder r JOIN by_code b USING (ean)
  UNION ALL SELECT r.source_row, b.supplier, b.n, b.n_usable, 1 FROM reorder r JOIN classes c ON c.code = r.ean JOIN classes d ON d.class = c.class AND d.code <> c.code JOIN by_code b ON b.ean = d.code),
summed AS (SELECT source_row, supplier, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_usable) AS BIGINT) AS n_usable, CAST(coalesce(sum(n) FILTER (WHERE via = 0), 0) AS BIGINT) AS n_exact, CAST(coalesce(sum(n) FILTER (WHERE via = 1), 0) AS BIGINT) AS n_via FROM found GROUP BY ALL)
SELECT source_row, supplier, n_exact, n_via, {_STATUS} AS status FROM summed""")
def match_with_equivalences(spark, sf):
    return matching.with_equivalences(reorder(spark, sf), price_list(spark, sf), _classes(spark, sf))


@query(f"""WITH {SQL_PRICE_LIST}, single AS (SELECT supplier, ean, min(unit_price_net) AS price FROM price_list WHERE usable GROUP BY ALL HAVING count(*) = 1)
SELECT ean, count(*) AS n_suppliers, CAST(min(price) AS DOUBLE) AS best_price, first(supplier ORDER BY price, supplier) AS best_supplier FROM single GROUP BY ean""")
def unique_ean_catalogue(spark, sf):
    return doubles(matching.unique_catalogue(price_list(spark, sf)))


@query(f"WITH {SQL_PRICE_LIST} SELECT supplier, ean, count(*) AS n, CAST(min(unit_price_net) AS DOUBLE) AS low, CAST(max(unit_price_net) AS DOUBLE) AS high FROM price_list WHERE usable GROUP BY ALL HAVING count(*) > 1")
def ambiguous_rows(spark, sf):
    return doubles(matching.ambiguous_rows(price_list(spark, sf)))


@query(f"""{_BASE} SELECT m.source_row, m.supplier, b.ean, CASE WHEN b.n_usable = 1 THEN 'PROPOSED' ELSE 'AMBIGUOUS' END AS outcome, CASE WHEN b.n_usable = 1 THEN b.only_row END AS proposed_row
FROM matrix m JOIN by_code b ON b.supplier = m.supplier AND b.n_usable > 0 AND b.ean = lpad(CAST(m.source_row + 1 AS VARCHAR), 13, '0')
WHERE m.status = 'ABSENT'""")
def same_code_propagation(spark, sf):
    accepted = reorder(spark, sf).select("source_row", F.lpad((F.col("source_row") + 1).cast("string"), 13, "0").alias("code"))
    return matching.propagate_code(accepted, _matrix(spark, sf), price_list(spark, sf))


_SAME = ", ".join(f"'{a}': '{b}'" for a, b in text.ALIASES.items())
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WORDS = f"list_distinct(list_filter(list_transform(string_split(trim(regexp_replace(upper(strip_accents({{0}})), '[^A-Z0-9.,]+', ' ', 'g')), ' '), lambda w: coalesce(MAP {{{{{_SAME}}}}}[w], w)), lambda w: len(w) > 1 AND w NOT IN ({_STOP})))"


def _described(spark, sf):
    return reorder(spark, sf).select("source_row", "description", "brand", text.tokens(F.col("description")).alias("tokens"))


@query(f"""WITH {SQL_REORDER}, w AS (SELECT source_row, brand, {_WORDS.format('description')} AS tokens FROM reorder),
pairs AS (SELECT q.source_row AS qid, i.source_row AS iid, len(list_intersect(q.tokens, i.tokens)) AS shared, len(q.tokens) + len(i.tokens) AS total
  FROM w q JOIN w i ON q.brand = i.brand AND q.source_row <> i.source_row)
SELECT qid, iid, CAST(shared AS INT) AS shared, score FROM (SELECT qid, iid, shared, CAST(shared AS DOUBLE) / (total - shared) AS score, row_number() OVER (PARTITION BY qid ORDER BY CAST(shared AS DOUBLE) / (total - shared) DESC, iid) AS k FROM pairs WHERE shared > 0) WHERE k <= 5""")
def token_jaccard_topk(spark, sf):
    """Of the rows of a product's brand, the five that share most of its words."""
    return similar.most_similar_words(*_sides(_described(spark, sf)), 5, apart=True).select("qid", "iid", "shared", F.col("words").alias("score"))


def _sides(w):
    rest = [c for c in w.columns if c not in ("source_row", "brand", "tokens", "description")]
    side = lambda key: w.select(F.col("source_row").alias(key), F.col("brand").alias("block"), F.col("tokens").alias("words"), *rest)
    return side("qid"), side("iid")


@query(f"""WITH {SQL_REORDER}, {SQL_PRICE_LIST}, w AS (SELECT source_row, ean, {_WORDS.format('description')} AS tokens FROM reorder),
words AS (SELECT source_row, ean, unnest(tokens) AS word FROM w),
alike AS (SELECT DISTINCT q.source_row AS qid, i.ean FROM words q JOIN words i ON i.word = q.word AND i.ean <> q.ean),
s AS (SELECT r.source_row AS qid, p.supplier, p.source_row AS iid, true AS same_ean, CAST(p.discount_rate AS DOUBLE) AS score FROM reorder r JOIN price_list p ON p.usable AND p.ean = r.ean
  UNION ALL SELECT a.qid, p.supplier, p.source_row, false, CAST(p.discount_rate AS DOUBLE) FROM alike a JOIN price_list p ON p.usable AND p.ean = a.ean),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, supplier ORDER BY same_ean DESC, score DESC, iid) AS rank, sum(CAST(same_ean AS INT)) OVER (PARTITION BY qid, supplier) AS forced FROM s)
SELECT qid, supplier, iid, same_ean, score FROM k WHERE rank <= greatest(2, forced)""")
def ean_forced_shortlist(spark, sf):
    """Rows of a product's code, then all rows that share a word with its description."""
    r = similar.of_texts(reorder(spark, sf).select(F.col("source_row").alias("qid"), "ean", "description"), "description", {"tokens": text.tokens(F.col("__text"))}).drop("description")
    p = price_list(spark, sf).where("usable").select("supplier", F.col("source_row").alias("iid"), "ean", F.col("discount_rate").cast("double").alias("score"))
    return matching.forced_shortlist(r, p, r.select("ean", "tokens"), 2).drop("rank")


@query()
def semantic_score(spark, sf):
    """Words, matching blocks and pack sizes of the rows of a product's brand that share a word with it; the five best."""
    # each description is read once
    made = {"tokens": text.tokens(F.col("__text")), "text": text.matching_text(F.col("__text")), "sizes": pack_attributes("__text")}
    w = similar.of_texts(reorder(spark, sf).select("source_row", "description", "brand"), "description", made)
    return similar.most_similar(*_sides(w), 5, apart=True).select("qid", "iid", "score", "conflicts", "rank")


@query()
def pack_sizes_of_products(spark, sf):
    return reorder(spark, sf).select("source_row", pack_attributes("description").alias("sizes"))


_DECISIONS = """decisions AS (SELECT source_row, supplier, CASE source_row % 3 WHEN 0 THEN 'ACCEPT' WHEN 1 THEN 'REJECT' ELSE 'ACCEPT' END AS action,
    source_row * 100 + CASE WHEN source_row % 5 = 0 THEN 9 ELSE 1 END AS chosen_row, CASE WHEN source_row % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence,
    CASE WHEN source_row % 7 = 0 THEN NULL WHEN source_row % 11 = 0 THEN 'old' ELSE 'now' END AS case_print FROM matrix WHERE status <> 'EXACT' AND source_row % 4 < 3),
shown AS (SELECT source_row, supplier, source_row * 100 + i AS row, 'now' AS case_print, source_row % 13 <> 0 AS identity_ok FROM matrix, range(3) t(i))"""


#: Each part computed once: joined to itself where it is used, the matrix was a plan of many copies.
_ONCE = f"{_BASE}, {_DECISIONS}".replace(" AS (\n", " AS MATERIALIZED (\n").replace("decisions AS (SELECT", "decisions AS MATERIALIZED (SELECT").replace("shown AS (SELECT", "shown AS MATERIALIZED (SELECT")


@query(f"""{_ONCE}, j AS MATERIALIZED (SELECT m.*, d.action, d.chosen_row, d.confidence, CASE WHEN m.status = 'EXACT' OR d.action IS NULL THEN NULL WHEN d.case_print IS NULL THEN 'NO_FINGERPRINT' WHEN d.case_print <> 'now' THEN 'OTHER_RUN'
    WHEN d.action = 'ACCEPT' AND d.chosen_row - m.source_row * 100 NOT IN (0, 1, 2) THEN 'ROW_NOT_SHOWN' WHEN d.action = 'ACCEPT' AND m.source_row % 13 = 0 THEN 'LIST_CHANGED' END AS cause
  FROM matrix m LEFT JOIN decisions d USING (source_row, supplier)),
o AS (SELECT *, action IS NOT NULL AND cause IS NULL AS fits FROM j)
SELECT source_row, supplier, CASE WHEN status = 'EXACT' THEN 'EXACT' WHEN fits AND action = 'ACCEPT' AND status = 'AMBIGUOUS' THEN 'AMBIGUOUS_RESOLVED' WHEN fits AND action = 'ACCEPT' THEN 'PROPOSED' WHEN fits AND action = 'REJECT' THEN 'REJECTED' WHEN cause IS NOT NULL THEN 'DISCARDED' ELSE status END AS outcome,
  cause, CASE WHEN status = 'EXACT' THEN selected_row WHEN fits AND action = 'ACCEPT' THEN chosen_row END AS row,
  status <> 'EXACT' AND fits AND action = 'ACCEPT' AND confidence <> 'HIGH' AS needs_confirmation FROM o""")
def resolve_cascade(spark, sf):
    return _resolved(spark, sf)


def _resolved(spark, sf):
    m = _matrix(spark, sf)
    row = F.col("source_row")
    decisions = m.where("status <> 'EXACT' AND source_row % 4 < 3").select("source_row", "supplier", F.when(row % 3 == 1, "REJECT").otherwise("ACCEPT").alias("action"), (row * 100 + F.when(row % 5 == 0, 9).otherwise(1)).alias("chosen_row"), F.when(row % 2 == 0, "HIGH").otherwise("LOW").alias("confidence"), F.when(row % 7 == 0, F.lit(None)).when(row % 11 == 0, "old").otherwise("now").alias("case_print"))
    shown = m.select("source_row", "supplier", F.explode(F.array(*[row * 100 + i for i in range(3)])).alias("row"), F.lit("now").alias("case_print"), (row % 13 != 0).alias("identity_ok"))
    return matching.resolve(m, decisions, shown)


@query(f"""{_BASE}, d AS (SELECT source_row % 7 = 0 AS none, source_row % 11 = 0 AS old, source_row % 3 <> 1 AND source_row % 5 = 0 AS hidden, source_row % 3 <> 1 AND source_row % 13 = 0 AS changed FROM matrix WHERE status <> 'EXACT' AND source_row % 4 < 3)
SELECT cause, count(*) AS n FROM (SELECT CASE WHEN none THEN 'NO_FINGERPRINT' WHEN old THEN 'OTHER_RUN' WHEN hidden THEN 'ROW_NOT_SHOWN' WHEN changed THEN 'LIST_CHANGED' END AS cause FROM d) WHERE cause IS NOT NULL GROUP BY cause""")
def discard_causes(spark, sf):
    return _resolved(spark, sf).where("cause is not null").groupBy("cause").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_REORDER} SELECT source_row, substr(sha256(CAST(source_row AS VARCHAR) || chr(31) || brand || chr(31) || description || chr(31) || ean || chr(30) || 'x'), 1, 16) AS fingerprint FROM reorder")
def case_fingerprint(spark, sf):
    return reorder(spark, sf).select("source_row", fingerprints.case(F.col("source_row"), F.col("brand"), F.col("description"), F.array(F.col("ean"), F.lit("x"))).alias("fingerprint"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_decisions(spark, sf):
    return matching.duplicate_keys(read(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_returnflag <> 'R' AND b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey)""")
def pairs_without_shortlist(spark, sf):
    x = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    gone, there = x.where("l_returnflag = 'R'"), x.where("l_returnflag <> 'R'")
    return gone.select("l_partkey", "l_suppkey").distinct().join(there, ["l_partkey", "l_suppkey"], "left_anti")


@query(f"""{_BASE}, {_OFFERS}, {_CHEAPEST} SELECT c.source_row, {_D.format('unit_price')}, CAST(CAST(unit_price - last_unit_price AS DECIMAL(18,4)) AS DOUBLE) AS difference FROM cheapest c JOIN reorder USING (source_row)""")
def price_against_last(spark, sf):
    best = offers.cheapest(_offers(spark, sf))
    return doubles(offers.against_last(best, reorder(spark, sf)).select("source_row", "unit_price", "difference"))


@query(f"""{_BASE}, {_OFFERS}, lower AS (SELECT * REPLACE (CASE WHEN supplier IN ('NATION_3', 'NATION_8') THEN CAST(unit_price * CAST(0.85 AS DECIMAL(9,4)) AS DECIMAL(18,4)) ELSE unit_price END AS unit_price, CASE WHEN supplier IN ('NATION_3', 'NATION_8') THEN CAST(order_price * CAST(0.85 AS DECIMAL(9,4)) AS DECIMAL(18,4)) ELSE order_price END AS order_price) FROM offers),
{_CHEAPEST.replace('FROM offers', 'FROM lower')} SELECT source_row, supplier, {_D.format('unit_price')}, n_offers FROM cheapest""")
def supplier_discount_reassign(spark, sf):
    rates = spark.createDataFrame([("NATION_3", "0.15"), ("NATION_8", "0.15")], "supplier string, r string").select("supplier", F.col("r").cast("decimal(9,4)").alias("rate"))
    return doubles(offers.cheapest(offers.discounted(_offers(spark, sf), rates)).select("source_row", "supplier", "unit_price", "n_offers"))


_LINES = "lines AS (SELECT c.source_row, c.supplier, r.suggested_cartons AS quantity, c.order_price, c.pieces FROM cheapest c JOIN reorder r USING (source_row))"
_TOTAL = "CAST(quantity * order_price AS DECIMAL(18,4))"


def _lines(spark, sf):
    r = reorder(spark, sf).select("source_row", F.col("suggested_cartons").alias("quantity"))
    return offers.cheapest(_offers(spark, sf)).join(r, "source_row").select("source_row", "supplier", "quantity", "order_price", "pieces")


@query(f"""{_BASE}, {_OFFERS}, {_CHEAPEST}, {_LINES} SELECT supplier, count(*) AS n_lines, CAST(sum({_TOTAL}) AS DOUBLE) AS total, CAST(sum(CAST({_TOTAL} AS DECIMAL(18,2))) AS DOUBLE) AS total_cents,
CAST(sum({_TOTAL}) - sum(CAST({_TOTAL} AS DECIMAL(18,2))) AS DOUBLE) AS gap FROM lines GROUP BY supplier""")
def order_summary_rounding(spark, sf):
    return doubles(offers.order_summary(_lines(spark, sf)))


@query(f"""{_BASE}, {_OFFERS}, {_CHEAPEST}, {_LINES}, t AS (SELECT supplier, sum({_TOTAL}) AS total FROM lines GROUP BY supplier), m AS (SELECT n_name AS supplier, CAST(CAST(n_nationkey AS BIGINT) * 100000000 AS DECIMAL(18,4)) AS minimum FROM nation)
SELECT supplier, CAST(total AS DOUBLE) AS total, CAST(minimum AS DOUBLE) AS minimum, CAST(minimum - total AS DOUBLE) AS missing FROM t JOIN m USING (supplier) WHERE total > 0 AND total < minimum""")
def below_minimum_order(spark, sf):
    minimum = read(spark, sf, "nation").select(F.col("n_name").alias("supplier"), (F.col("n_nationkey").cast("long") * 100000000).cast(numbers.MONEY).alias("minimum"))
    return doubles(offers.below_minimum(offers.order_summary(_lines(spark, sf)), minimum))


@query(f"""{_BASE}, {_OFFERS}, {_CHEAPEST}, {_LINES}, mv AS (SELECT source_row, quantity, order_price AS old_price FROM lines WHERE supplier = 'NATION_3')
SELECT o.supplier, count(*) AS n_moved, (SELECT count(*) FROM mv) - count(*) AS n_left, CAST(sum(CAST(quantity * old_price AS DECIMAL(18,4))) AS DOUBLE) AS old_cost, CAST(sum({_TOTAL}) AS DOUBLE) AS new_cost,
  CAST(sum({_TOTAL}) - sum(CAST(quantity * old_price AS DECIMAL(18,4))) AS DOUBLE) AS difference FROM mv JOIN offers o USING (source_row) WHERE o.supplier <> 'NATION_3' GROUP BY o.supplier""")
def move_preview_by_supplier(spark, sf):
    return doubles(offers.move_preview(_lines(spark, sf), _offers(spark, sf), "NATION_3"))


@query(f"""{_BASE}, {_OFFERS}, {_CHEAPEST}, {_LINES}, b AS (SELECT *, row_number() OVER (PARTITION BY source_row ORDER BY unit_price, supplier, order_price) AS k FROM offers WHERE supplier <> 'NATION_3')
SELECT l.source_row, l.quantity, b.supplier AS to_supplier, CAST(b.unit_price AS DOUBLE) AS unit_price, CAST(b.order_price AS DOUBLE) AS order_price FROM lines l LEFT JOIN b ON b.k = 1 AND b.source_row = l.source_row WHERE l.supplier = 'NATION_3'""")
def move_preview_best(spark, sf):
    return doubles(offers.move_to_best(_lines(spark, sf), _offers(spark, sf), "NATION_3"))


@query("SELECT l_suppkey AS supplier, l_partkey AS offer_row, count(*) AS n, count(DISTINCT l_quantity) AS n_factors FROM lineitem GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT l_quantity) > 1")
def contested_rows(spark, sf):
    lines = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("offer_row"), F.col("l_quantity").alias("pieces"))
    return offers.contested_rows(lines)


@query(f"""{_WIDER}, s AS (SELECT source_row, n_usable > 0 AS usable, status, source_row % 50 = 0 AS rejected FROM matrix)
SELECT source_row, CASE WHEN bool_or(rejected) THEN 'rejected' WHEN bool_and(status = 'ABSENT') THEN 'not listed' ELSE 'unavailable' END AS reason FROM s GROUP BY source_row HAVING NOT bool_or(usable)""")
def to_source_list(spark, sf):
    m = _wider(spark, sf).select("source_row", (F.col("n_usable") > 0).alias("usable"), "status", (F.col("source_row") % 50 == 0).alias("rejected"))
    return aggregates.why_missing(m)


_SEARCH = "lower(trim(regexp_replace(upper(strip_accents(description)), '[^A-Z0-9]+', ' ', 'g')))"


@query(f"""WITH {SQL_REORDER}, s AS (SELECT source_row, ean, {_SEARCH} AS search, CAST(last_unit_price AS DOUBLE) AS price FROM reorder)
SELECT source_row, ean, search, price FROM s WHERE contains(search, 'brand') AND contains(search, '12') ORDER BY ean = 'brand 12' DESC, starts_with(search, 'brand 12') DESC, price, search, ean LIMIT 20""")
def catalog_search(spark, sf):
    s = reorder(spark, sf).select("source_row", "ean", text.search_text(F.col("description")).alias("search"), F.col("last_unit_price").cast("double").alias("price"))
    return offers.search_rank(s, "brand 12", price="price")


@query(f"WITH {SQL_REORDER} SELECT source_row, ean, {_SEARCH} AS search FROM reorder ORDER BY search, source_row LIMIT 50 OFFSET 100")
def catalog_page(spark, sf):
    s = reorder(spark, sf).select("source_row", "ean", text.search_text(F.col("description")).alias("search"))
    return offers.page_of(s, ["search", "source_row"], 2, 50)
