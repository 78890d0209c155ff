"""Which rows of which supplier a product resolves to.

Every product has a status for every supplier: EXACT (one usable row of its code), AMBIGUOUS (several),
PRESENT_UNUSABLE (rows, none usable), ABSENT (none). Counts per code and supplier are aggregated before any join, so
the dense matrix joins one row per pair, and only the supplier list, checked to be small, meets all products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .graph import components

#: Suppliers that may be sent to every task; a supplier list beyond this is joined without a hint.
SMALL_SIDE_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """df with a broadcast hint if it is proven to be small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def status_of(n: Column, usable: Column) -> Column:
    return F.when(usable == 1, "EXACT").when(usable > 1, "AMBIGUOUS").when(n > 0, "PRESENT_UNUSABLE").otherwise("ABSENT")


def candidates_by_code(prices: DataFrame) -> DataFrame:
    """supplier, ean, n, n_usable, only_row (the usable row if there is one)."""
    return prices.groupBy("supplier", "ean").agg(F.count("*").alias("n"), F.count_if("usable").alias("n_usable"), F.min(F.when(F.col("usable"), F.col("source_row"))).alias("only_row"))


def match_matrix(reorder: DataFrame, prices: DataFrame, suppliers: DataFrame) -> DataFrame:
    """One row per product and supplier: source_row, ean, supplier, status, n_candidates, n_usable, selected_row."""
    pairs = reorder.select("source_row", "ean").crossJoin(small(suppliers.select("supplier").distinct()))
    found = pairs.join(candidates_by_code(prices), ["supplier", "ean"], "left")
    n, usable = F.coalesce("n", F.lit(0)), F.coalesce("n_usable", F.lit(0))
    return found.select("source_row", "ean", "supplier", status_of(n, usable).alias("status"), n.alias("n_candidates"), usable.alias("n_usable"), F.when(usable == 1, F.col("only_row")).alias("selected_row"))


def equivalence_classes(edges: DataFrame) -> DataFrame:
    """code, class (its smallest code) of every code that an edge a, b names."""
    return components(edges).select(F.col("node").alias("code"), F.col("component").alias("class"))


def with_equivalences(reorder: DataFrame, prices: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates per product and supplier, by the code itself and by equal codes: source_row, supplier, n_exact, n_via, status.

    Codes of a class don't meet: what the others have is what the class has, less what the code has. classes: code (once
    each), class."""
    counted = candidates_by_code(prices).select("supplier", "ean", "n", "n_usable")
    products = reorder.select("source_row", "ean").join(classes.select(F.col("code").alias("ean"), "class"), "ean", "left")
    whole = counted.join(classes.select(F.col("code").alias("ean"), "class"), "ean").groupBy("class", "supplier").agg(F.sum("n").alias("n"), F.sum("n_usable").alias("n_usable"))
    via = F.col("class").isNotNull()
    own = products.join(counted, "ean").select("source_row", "supplier", "n", F.when(via, -F.col("n")).otherwise(0).alias("n_via"), F.when(via, 0).otherwise(F.col("n_usable")).alias("n_usable"))
    all_ = products.join(whole, "class").select("source_row", "supplier", F.lit(0).alias("n"), F.col("n").alias("n_via"), "n_usable")
    both = own.unionByName(all_).groupBy("source_row", "supplier").agg(F.sum("n").alias("n_exact"), F.sum("n_via").alias("n_via"), F.sum("n_usable").alias("n_usable"))
    return both.select("source_row", "supplier", "n_exact", "n_via", status_of(F.col("n_exact") + F.col("n_via"), F.col("n_usable")).alias("status"))


def unique_catalogue(prices: DataFrame) -> DataFrame:
    """Rows whose code is unique in their supplier's list, merged by code: ean, suppliers, cheapest price and supplier."""
    usable = prices.where("usable")
    single = usable.groupBy("supplier", "ean").agg(F.count("*").alias("n"), F.min("unit_price_net").alias("price")).where("n = 1")
    return single.groupBy("ean").agg(F.count("*").alias("n_suppliers"), F.min(F.struct("price", "supplier")).alias("best")).select("ean", "n_suppliers", F.col("best.price").alias("best_price"), F.col("best.supplier").alias("best_supplier"))


def ambiguous_rows(prices: DataFrame) -> DataFrame:
    """Codes that a supplier lists more than once among its usable rows."""
    return prices.where("usable").groupBy("supplier", "ean").agg(F.count("*").alias("n"), F.min("unit_price_net").alias("low"), F.max("unit_price_net").alias("high")).where("n > 1")


def propagate_code(accepted: DataFrame, matrix: DataFrame, prices: DataFrame) -> DataFrame:
    """Where a row with another code was accepted for a product, the unique usable row of that code at each supplier
    that lacks the product: source_row, supplier, ean, outcome (PROPOSED or AMBIGUOUS), proposed_row.

    accepted: source_row, code."""
    absent = matrix.where("status = 'ABSENT'").select("source_row", "supplier")
    usable = candidates_by_code(prices).where("n_usable > 0").select(F.col("supplier"), F.col("ean").alias("code"), "n_usable", "only_row")
    found = absent.join(accepted.select("source_row", "code").distinct(), "source_row").join(usable, ["supplier", "code"])
    return found.select("source_row", "supplier", F.col("code").alias("ean"), F.when(F.col("n_usable") == 1, "PROPOSED").otherwise("AMBIGUOUS").alias("outcome"), F.when(F.col("n_usable") == 1, F.col("only_row")).alias("proposed_row"))


def token_candidates(queries: DataFrame, items: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Pairs with a word in common, with the number of common words: qid, iid, shared.

    An inverted index: words are joined, not rows. Both sides: an id and a word array."""
    q = queries.select("qid", F.explode(tokens).alias("word"))
    i = items.select("iid", F.explode(tokens).alias("word"))
    return q.join(i, "word").groupBy("qid", "iid").agg(F.count("*").alias("shared"))


def shortlist(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k best of each query and supplier; rows of the same code stay however many they are.

    scored: qid, supplier, iid, same_ean, score. Two windows of one partitioning."""
    best = Window.partitionBy("qid", "supplier").orderBy(F.desc("same_ean"), F.desc("score"), "iid")
    whole = Window.partitionBy("qid", "supplier")
    ranked = scored.withColumn("rank", F.row_number().over(best)).withColumn("forced", F.sum(F.col("same_ean").cast("int")).over(whole))
    return ranked.where(F.col("rank") <= F.greatest(F.lit(k), F.col("forced"))).drop("forced")


def _set(tokens: Column) -> Column:
    """The words of a text as one value, in whatever order they come."""
    return F.concat_ws("\x1f", F.array_sort(F.array_distinct(tokens)))


def best_by_word(items: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """word, supplier, place, iid, ean, score: of the rows of a word and supplier those that can be among the k best of a
    product. place: of a row among those of its supplier that are left, the best first.

    A product takes no row of its own code here, so k rows of a code and 2k in all hold the k best of any product. They
    are taken by code, then by set of words, then by word. items: supplier, iid, ean, score; words: ean, tokens."""
    order = [F.desc("score"), F.asc("iid")]
    first = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(*order))
    few = items.withColumn("of", first("supplier", "ean")).where(F.col("of") <= k)
    sets = words.select("ean", _set(F.col("tokens")).alias("set")).where("set <> ''").distinct()
    of_set = few.join(sets, "ean").withColumn("at", first("supplier", "set")).where(F.col("at") <= 2 * k)
    by_word = of_set.select(F.explode(F.split("set", "\x1f")).alias("word"), "supplier", "iid", "ean", "of", "score").distinct()
    by_word = by_word.withColumn("at", first("word", "supplier")).where(F.col("at") <= 2 * k)
    place = F.dense_rank().over(Window.partitionBy("supplier").orderBy(*order, "ean", "of"))
    return by_word.select("word", "supplier", place.alias("place"), "iid", "ean", "score")


def _best_of_set(sets: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """set, best: of each supplier the rows of the words of a set that can be among the k best of a product, the best first."""
    asked = sets.select("set").distinct().where("set <> ''").repartition("set").select("set", F.explode(F.split("set", "\x1f")).alias("word"))
    # words are few as a rule; then a set's rows stay in its task
    places = best.groupBy("word", "supplier").agg(F.collect_list("place").alias("places"))
    found = asked.join(small(places), "word").groupBy("set", "supplier").agg(F.flatten(F.collect_list("places")).alias("places"))
    found = found.select("set", "supplier", F.explode(F.slice(F.sort_array(F.array_distinct("places")), 1, 2 * k)).alias("place"))
    rows = found.join(small(best.drop("word").distinct()), ["supplier", "place"])
    rows = rows.groupBy("set", "supplier").agg(F.sort_array(F.collect_list(F.struct("place", "iid", "ean", "score"))).alias("rows"))
    return rows.groupBy("set").agg(F.collect_list(F.struct("supplier", "rows")).alias("best"))


def forced_shortlist(products: DataFrame, items: DataFrame, words: DataFrame, k: int = 5) -> DataFrame:
    """shortlist of all rows of a product's code and all rows that share a word with it, by a score of the row alone.

    products: qid (once each), ean, tokens; items: supplier, iid, ean, score; words: ean, tokens. Words meet their best rows
    only, and products of the same words share them; rows of a code are counted, not ranked, as all of them stay."""
    own = products.select("qid", "ean").join(items, "ean").select("qid", "supplier", "iid", F.lit(True).alias("same_ean"), "score")
    counted = items.groupBy("ean", "supplier").agg(F.count("*").alias("n")).where("supplier is not null")
    counted = counted.groupBy("ean").agg(F.map_from_entries(F.collect_list(F.struct("supplier", "n"))).alias("n_own"))
    asked = products.select("qid", "ean", _set(F.col("tokens")).alias("set"))
    best = _best_of_set(asked, cut(best_by_word(items, words, k)), k)
    alike = asked.join(counted, "ean", "left").join(best, "set").select("qid", "ean", "n_own", F.explode("best").alias("of"))
    left = F.greatest(F.lit(k) - F.coalesce(F.col("n_own")[F.col("of.supplier")], F.lit(0)), F.lit(0)).cast("int")
    others = F.slice(F.filter("of.rows", lambda x: x["ean"] != F.col("ean")), F.lit(1), left)
    alike = alike.select("qid", "of.supplier", F.explode(others).alias("row")).select("qid", "supplier", "row.iid", F.lit(False).alias("same_ean"), "row.score")
    rank = F.row_number().over(Window.partitionBy("qid", "supplier").orderBy(F.desc("same_ean"), F.desc("score"), "iid"))
    return own.unionByName(alike).withColumn("rank", rank)


def resolve(matrix: DataFrame, decisions: DataFrame, shown: DataFrame) -> DataFrame:
    """The outcome of every pair: exact matches first, then decisions that still fit what was shown.

    decisions: source_row, supplier, action, chosen_row, confidence, case_print. shown: source_row, supplier, row (of
    the shortlist), case_print, identity_ok. A decision for another question, for a row that was not shown or for a row
    that has changed is discarded, with the cause."""
    rows = shown.groupBy("source_row", "supplier").agg(F.collect_set("row").alias("rows"), F.max("case_print").alias("shown_print"), F.collect_set(F.when(F.col("identity_ok"), F.col("row"))).alias("same"))
    both = matrix.join(decisions, ["source_row", "supplier"], "left").join(rows, ["source_row", "supplier"], "left")
    accept, exact = F.col("action") == "ACCEPT", F.col("status") == "EXACT"
    stale = F.when(F.col("case_print").isNull(), "NO_FINGERPRINT").when(F.col("shown_print").isNull() | (F.col("case_print") != F.col("shown_print")), "OTHER_RUN")
    cause = F.when(exact | F.col("action").isNull(), F.lit(None).cast("string")).otherwise(F.coalesce(stale, F.when(accept & ~F.array_contains("rows", F.col("chosen_row")), "ROW_NOT_SHOWN").when(accept & ~F.array_contains("same", F.col("chosen_row")), "LIST_CHANGED")))
    fits = F.col("action").isNotNull() & cause.isNull()
    outcome = F.when(exact, "EXACT").when(fits & accept & (F.col("status") == "AMBIGUOUS"), "AMBIGUOUS_RESOLVED").when(fits & accept, "PROPOSED").when(fits & (F.col("action") == "REJECT"), "REJECTED").when(cause.isNotNull(), "DISCARDED").otherwise(F.col("status"))
    sure = exact | (fits & accept & (F.col("confidence") == "HIGH"))
    return both.select("source_row", "supplier", outcome.alias("outcome"), cause.alias("cause"), F.when(exact, F.col("selected_row")).when(fits & accept, F.col("chosen_row")).alias("row"), (~sure & outcome.isin("AMBIGUOUS_RESOLVED", "PROPOSED")).alias("needs_confirmation"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
