"""What comes in and what goes out: cleaned catalogues, chosen rows, saved choices, destinations, whole shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import block_ratio, pack_attributes, pair_score, size_comparison, word_jaccard
from ..session import cut
from . import similar
from .matching import shortlist


def checked_catalogue(rows: DataFrame, product: str, price: str, page: str) -> DataFrame:
    """rows, white space collapsed, with discarded: NO_DESCRIPTION, NO_PRICE (not a price in Italian form; 0 is one),
    DUPLICATE (equal but for the page and case to an earlier row), NO_PAGE; NULL where the row stays. row: their order.

    First occurrences are a grouped minimum, not a sort; rows turned down for text or price take no part in it."""
    others = [c for c in rows.columns if c != "row"]
    clean = rows.select("row", *[F.coalesce(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " ")), F.lit("")).alias(c) for c in others])
    # points part thousands only, a comma starts the decimals; spaces of any kind inside don't count
    priced = F.regexp_replace(F.col(price), r"[ \u00a0]", "").rlike(r"^([0-9]{1,3}(\.[0-9]{3})+|[0-9]+)(,[0-9]+)?$")
    first = F.when(F.col(product) == "", "NO_DESCRIPTION").when(~priced, "NO_PRICE")
    clean = clean.withColumn("discarded", first)
    key = F.sha2(F.concat_ws("\x1f", *[F.lower(c) for c in others if c != page]), 256)
    taking = clean.where("discarded is null").groupBy(key.alias("__key")).agg(F.min("row").alias("__first"))
    out = clean.withColumn("__key", key).join(taking, "__key", "left")
    later = F.when(F.col("row") != F.col("__first"), "DUPLICATE").when(~F.coalesce(F.col(page).try_cast("int") >= 1, F.lit(False)), "NO_PAGE")
    return out.withColumn("discarded", F.coalesce("discarded", later)).drop("__key", "__first")


def catalogue_report(checked: DataFrame, page: str) -> DataFrame:
    """One row: n_read, n_kept, last_page, n_missing_pages (of 1 to the last one) and the discarded rows by cause."""
    kept, at = F.col("discarded").isNull(), F.col(page).try_cast("int")
    causes = [F.count_if(F.coalesce(F.col("discarded") == c, F.lit(False))).alias(f"n_{c.lower()}") for c in ("NO_DESCRIPTION", "NO_PRICE", "DUPLICATE", "NO_PAGE")]
    out = checked.agg(F.count("*").alias("n_read"), F.count_if(kept).alias("n_kept"), F.coalesce(F.max(F.when(kept, at)), F.lit(0)).alias("last_page"), F.countDistinct(F.when(kept, at)).alias("n_pages"), *causes)
    return out.withColumn("n_missing_pages", F.col("last_page") - F.col("n_pages")).drop("n_pages")


def offers_from_rows(chosen: DataFrame, prices: DataFrame) -> DataFrame:
    """The rows that a user chose as offers, with an error where there is none: NO_LIST, NO_ROW, NOT_ORDERABLE. A
    number that a list holds twice gives two.

    chosen: supplier, source_row. prices: supplier, source_row, unit_price_net, pieces_per_carton, usable."""
    lists = prices.select(F.col("supplier").alias("__supplier")).distinct()
    fields = ("unit_price_net", "pieces_per_carton")
    rows = prices.select("supplier", "source_row", *fields, "usable", F.lit(True).alias("__there"))
    j = chosen.join(rows, ["supplier", "source_row"], "left").join(lists, F.col("supplier") == F.col("__supplier"), "left")
    ok = F.coalesce((F.col("unit_price_net") > 0) & (F.col("pieces_per_carton") > 0) & F.col("usable"), F.lit(False))
    error = F.when(F.col("__supplier").isNull(), "NO_LIST").when(F.col("__there").isNull(), "NO_ROW").when(~ok, "NOT_ORDERABLE")
    return j.select("supplier", "source_row", *[F.when(error.isNull(), F.col(c)).alias(c) for c in fields], error.alias("error"))


def with_saved_choices(automatic: DataFrame, saved: DataFrame) -> DataFrame:
    """automatic with the user's choices over it: a supplier that the user chose stays, one that was chosen by itself is
    derived anew, and quantities are those saved, none below 0.

    automatic: source_row, supplier, quantity. saved: source_row, supplier, quantity, by_user."""
    s = saved.select("source_row", F.col("supplier").alias("__supplier"), F.col("quantity").alias("__quantity"), F.col("by_user").alias("__by_user"))
    mine = F.coalesce("__by_user", F.lit(False)) & F.col("__supplier").isNotNull()
    out = automatic.join(s, "source_row", "left")
    return out.select("source_row", F.when(mine, F.col("__supplier")).otherwise(F.col("supplier")).alias("supplier"), F.greatest(F.coalesce("__quantity", "quantity"), F.lit(0)).alias("quantity"), mine.alias("by_user"))


def destinations(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """plan with outcome: ERROR where the row no longer carries the planned code, WARNING where no code is planned and
    the description differs, UNCHECKED without either, VERIFIED.

    plan: supplier, row, ean, description. rows: supplier, row, ean, description."""
    there = rows.select("supplier", "row", text.ean(F.col("ean")).alias("__ean"), text.name_text(F.col("description")).alias("__name"))
    code, name = text.blank_to_null(text.ean(F.col("ean"))), text.blank_to_null(text.name_text(F.col("description")))
    same = lambda a, b: F.coalesce(F.col(a) == b, F.lit(False))
    outcome = F.when(code.isNotNull(), F.when(same("__ean", code), "VERIFIED").otherwise("ERROR")).when(name.isNull(), "UNCHECKED").when(same("__name", name), "VERIFIED").otherwise("WARNING")
    return plan.join(there, ["supplier", "row"], "left").withColumn("outcome", outcome).drop("__ean", "__name")


def end_of_data(grid: DataFrame, columns: list[int], start: int) -> DataFrame:
    """One row, last_row: the last row from `start` on with any of the columns (from 1) filled; start - 1 without one."""
    filled = F.lit(False)
    for n in columns:
        filled = filled | F.coalesce(F.trim(F.get("cells", F.lit(n - 1))) != "", F.lit(False))
    return grid.agg(F.coalesce(F.max(F.when(filled & (F.col("source_row") >= start), F.col("source_row"))), F.lit(start - 1)).alias("last_row"))


def readable_identity(fingerprint: Column) -> Column:
    """struct<supplier, ean, code, name, search> of an article's fingerprint; missing fields are empty."""
    part = lambda i: F.coalesce(F.get(F.split(fingerprint, r"\|"), F.lit(i)), F.lit("")).alias
    return F.struct(part(0)("supplier"), part(1)("ean"), part(2)("code"), part(3)("name"), text.search_text(F.regexp_replace(fingerprint, r"\|", " ")).alias("search"))


def shortlists(queue: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """The k best rows of each question, rows of its code first and however many: qid, supplier, iid, same_ean, score,
    rank.

    queue: qid, supplier, ean, description. rows: supplier, iid, ean, description, price, usable, row_type. Candidates
    share a word or the code: those of the code by an equi-join, the k best by words, sizes and blocks by the pruned join,
    which holds whatever is left of the k behind the rows of the code. Sizes are read once a text."""
    fit = rows.where((F.col("description") != "") & F.coalesce(F.col("price") > 0, F.lit(False)) & F.coalesce("usable", F.lit(True)) & (F.coalesce("row_type", F.lit("")) != "DISPLAY_COMPONENT"))
    made = {"words": text.tokens(F.col("__text")), "text": text.matching_text(F.col("__text")), "sizes": pack_attributes("__text")}
    read = lambda df, key, name: similar.of_texts(df.select(F.struct("supplier", key).alias(name), F.col("supplier").alias("block"), F.trim("ean").alias("ean"), "description"), "description", made).drop("description")
    q, r = read(queue, "qid", "qid"), read(fit, "iid", "iid")
    best = similar.most_similar(q.drop("ean"), r.drop("ean"), k).select("qid", "iid", "score")
    sides = [df.where("ean <> ''").select("block", "ean", key, *[F.col(c).alias(c + s) for c in ("words", "text", "sizes")]) for df, key, s in ((q, "qid", "_a"), (r, "iid", "_b"))]
    own = sides[0].join(sides[1], ["block", "ean"])
    score = pair_score(word_jaccard(F.col("words_a"), F.col("words_b")), F.col("blocks"), size_comparison(F.col("sizes_a"), F.col("sizes_b")))
    own = cut(own.withColumn("blocks", block_ratio("text_a", "text_b")).select("qid", "iid", score.alias("score"), F.lit(True).alias("same_ean")))
    others = best.join(own.select("qid", "iid"), ["qid", "iid"], "left_anti").withColumn("same_ean", F.lit(False))
    scored = others.unionByName(own).select(F.col("qid.qid").alias("qid"), F.col("qid.supplier").alias("supplier"), F.col("iid.iid").alias("iid"), "same_ean", "score")
    return shortlist(scored, k)
