"""Memories in time: valid-from and valid-to versions, pending orders, expiry, latest versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(log: DataFrame, keys: list[str], value: str, at: str, tie: str) -> DataFrame:
    """A row for each change of value: keys, value, valid_from, valid_to (NULL for the current one). Answers that repeat
    the last one change nothing."""
    order = Window.partitionBy(*keys).orderBy(at, tie)
    changed = log.withColumn("__last", F.lag(value).over(order)).withColumn("__n", F.row_number().over(order))
    changed = changed.where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__last")))
    return changed.select(*keys, value, F.col(at).alias("valid_from"), F.lead(at).over(order).alias("valid_to"))


def current(log: DataFrame, keys: list[str], at: str, tie: str, *values: str) -> DataFrame:
    """The last answer for each key: a grouped maximum, with partial maxima before the shuffle."""
    last = log.groupBy(*keys).agg(F.max(F.struct(at, tie, *values)).alias("last"))
    return last.select(*keys, *[F.col(f"last.{v}").alias(v) for v in values], F.col(f"last.{at}").alias(at))


def without_rejected(offers: DataFrame, rejections: DataFrame, keys: list[str]) -> DataFrame:
    return offers.join(rejections.select(*keys).distinct(), keys, "left_anti")


def last_activity(created: Column, answered: Column) -> Column:
    return F.greatest(created, answered)  # skips NULLs


def expired(orders: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """Pending orders without activity for more than so many days; exactly as many is still pending. Unreadable dates expire."""
    at = last_activity(F.col("created"), F.col("answered"))
    return orders.where((F.col("status") == "pending") & F.coalesce(at < now - F.make_interval(days=F.lit(days)), F.lit(True)))


def ask_again_at(answered: Column, asked_again: Column, days: int = 7) -> Column:
    """So long after a no, unless the question was put again since."""
    return F.when(asked_again.isNull() | (asked_again < answered), answered + F.make_interval(days=F.lit(days)))


def pending_by_identity(lines: DataFrame) -> DataFrame:
    """Per product identity: pending orders, quantity on the way, first and last date."""
    return lines.where("status = 'pending'").groupBy("identity").agg(F.countDistinct("order_id").alias("n_orders"), F.sum("quantity").alias("quantity"), F.min("created").alias("first_created"), F.max("created").alias("last_created"))


def latest_per(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row with the greatest order columns of each key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("b"))
    return best.select(*keys, "b.*")


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Runs of events with no silence of gap or more between them."""
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")
