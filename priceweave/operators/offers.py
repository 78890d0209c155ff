"""Offers: prices per piece and per order, the cheapest one, discounts, totals and what-if moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import MONEY, cents, order_price
from .matching import small, status_of


def available(price: Column, pieces: Column, usable: Column) -> Column:
    return F.coalesce((price > 0) & (pieces > 0) & usable, F.lit(False))


def offers_of(reorder: DataFrame, prices: DataFrame) -> DataFrame:
    """A row per product and supplier with a usable row: the cheapest one per piece, and the pair's status.

    One pass over the price lists: counts and the cheapest row come from the same grouped aggregation, whose result (a
    row per supplier and code) is all that meets the products."""
    ok = available(F.col("unit_price_net"), F.col("pieces_per_carton"), F.col("usable"))
    best = F.min(F.when(ok, F.struct("unit_price_net", "pieces_per_carton", "source_row"))).alias("best")
    by_code = prices.groupBy("supplier", "ean").agg(F.count("*").alias("n"), F.count_if("usable").alias("n_usable"), best).where("best is not null")
    out = reorder.select(F.col("source_row").alias("product"), "ean").join(by_code, "ean")
    return out.select(F.col("product").alias("source_row"), "ean", "supplier", status_of(F.col("n"), F.col("n_usable")).alias("status"), F.col("best.unit_price_net").alias("unit_price"), F.col("best.pieces_per_carton").alias("pieces"), order_price(F.col("best.unit_price_net"), F.col("best.pieces_per_carton")).alias("order_price"), F.col("best.source_row").alias("offer_row"))


def cheapest(offers: DataFrame, preference: list[str] | None = None) -> DataFrame:
    """One offer per product, by price per piece, then by the given order of suppliers, then by name: a grouped minimum,
    not a sort."""
    rank = F.lit(0)
    if preference:
        rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in preference]), F.col("supplier")), F.lit(0))
        rank = F.when(rank == 0, len(preference) + 1).otherwise(rank)
    best = offers.withColumn("preference", rank).groupBy("source_row").agg(F.min(F.struct("unit_price", "preference", "supplier", "pieces", "order_price")).alias("b"), F.count("*").alias("n_offers"))
    return best.select("source_row", F.col("b.supplier").alias("supplier"), F.col("b.unit_price").alias("unit_price"), F.col("b.pieces").alias("pieces"), F.col("b.order_price").alias("order_price"), "n_offers")


def priced(offers: DataFrame, unit: str = "unit_price", order: str = "order_price", pieces: str = "pieces") -> DataFrame:
    """Each of the two prices from the other where it is missing; both NULL without one of them or with a negative one."""
    u, o, n = F.col(unit), F.col(order), F.col(pieces)
    order_ = F.coalesce(o, (u * n).cast(MONEY))
    unit_ = F.coalesce(u, F.when(n > 0, (o / n).cast(MONEY)))
    ok = unit_.isNotNull() & (order_ >= 0)
    return offers.withColumn(unit, F.when(ok, unit_)).withColumn(order, F.when(ok, order_))


def discounted(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """Every price of a supplier with a rate from 0 to 1 (both excluded) lowered by it. rates: supplier, rate."""
    cut = small(rates.where((F.col("rate") > 0) & (F.col("rate") < 1)))
    kept = F.lit(1) - F.coalesce("rate", F.lit(0).cast("decimal(9,4)"))
    return offers.join(cut, "supplier", "left").withColumn("unit_price", (F.col("unit_price") * kept).cast(MONEY)).withColumn("order_price", (F.col("order_price") * kept).cast(MONEY)).drop("rate")


def against_last(offers: DataFrame, reorder: DataFrame) -> DataFrame:
    """Difference to the last price paid."""
    return offers.join(reorder.select("source_row", "last_unit_price"), "source_row").withColumn("difference", (F.col("unit_price") - F.col("last_unit_price")).cast(MONEY))


def order_summary(lines: DataFrame) -> DataFrame:
    """Per supplier: lines, total, total of lines rounded to cents, and the gap. lines: supplier, quantity, order_price."""
    total = (F.col("quantity") * F.col("order_price")).cast(MONEY)
    return lines.groupBy("supplier").agg(F.count("*").alias("n_lines"), F.sum(total).alias("total"), F.sum(cents(total)).alias("total_cents")).withColumn("gap", F.col("total") - F.col("total_cents"))


def below_minimum(summary: DataFrame, minimum: DataFrame) -> DataFrame:
    """Suppliers with an order that is not empty and under their minimum."""
    joined = summary.join(small(minimum), "supplier", "left").withColumn("minimum", F.coalesce("minimum", F.lit(0).cast(MONEY)))
    return joined.where((F.col("total") > 0) & (F.col("total") < F.col("minimum"))).select("supplier", "total", "minimum", (F.col("minimum") - F.col("total")).alias("missing"))


def move_preview(lines: DataFrame, offers: DataFrame, source: str) -> DataFrame:
    """What each other supplier could take over from one: lines it offers, old and new cost, and what stays behind.

    lines: source_row, supplier, quantity, order_price."""
    moving = lines.where(F.col("supplier") == source).select("source_row", "quantity", F.col("order_price").alias("old_price"))
    n = moving.agg(F.count("*").alias("n_all"))
    options = moving.join(offers.where(F.col("supplier") != source).select("source_row", "supplier", F.col("order_price").alias("new_price")), "source_row")
    q = lambda c: F.sum((F.col("quantity") * F.col(c)).cast(MONEY))
    by = options.groupBy("supplier").agg(F.count("*").alias("n_moved"), q("old_price").alias("old_cost"), q("new_price").alias("new_cost"))
    return by.crossJoin(F.broadcast(n)).select("supplier", "n_moved", (F.col("n_all") - F.col("n_moved")).alias("n_left"), "old_cost", "new_cost", (F.col("new_cost") - F.col("old_cost")).alias("difference"))


def move_to_best(lines: DataFrame, offers: DataFrame, source: str) -> DataFrame:
    """Each line of one supplier with its cheapest other offer."""
    moving = lines.where(F.col("supplier") == source).select("source_row", "quantity")
    best = offers.where(F.col("supplier") != source).groupBy("source_row").agg(F.min(F.struct("unit_price", "supplier", "order_price")).alias("b"))
    return moving.join(best, "source_row", "left").select("source_row", "quantity", F.col("b.supplier").alias("to_supplier"), F.col("b.unit_price").alias("unit_price"), F.col("b.order_price").alias("order_price"))


def contested_rows(lines: DataFrame) -> DataFrame:
    """Price-list rows that several lines of a plan use with different factors."""
    return lines.groupBy("supplier", "offer_row").agg(F.count("*").alias("n"), F.countDistinct("pieces").alias("n_factors")).where("n > 1 and n_factors > 1")


def page_of(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of an ordered list. Sorted by range over all tasks; only the page's rows are numbered in one."""
    first = page * size
    return df.orderBy(*order).offset(first).limit(size)


def search_rank(df: DataFrame, query: str, name: str = "search", ean: str = "ean", price: str = "best_price", limit: int = 20) -> DataFrame:
    """All words in the text; the exact code first, then texts that start with the query, then the cheapest."""
    words = [w for w in query.lower().split() if w]
    keep = F.lit(len(query) >= 2)
    for w in words:
        keep = keep & F.contains(F.col(name), F.lit(w))
    return df.where(keep).orderBy(F.desc(F.col(ean) == query), F.desc(F.startswith(F.col(name), F.lit(query.lower()))), F.col(price), F.col(name), F.col(ean)).limit(limit)


def rank_within(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
