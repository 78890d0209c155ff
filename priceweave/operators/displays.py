"""Displays: mixed cartons that a list describes by a parent row and the rows of its parts below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fingerprints import composition
from .aggregates import poisoned_sum

TERM = r"\b(?:ESPO(?:SITORE)?|DISPLAY|EXPO)\b"
NEGATED = r"\b(?:NO|SENZA)\s+(?:ESPO(?:SITORE)?|DISPLAY|EXPO)\b"


def bundles(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Blocks of a parent and at least two component rows right below it: by, parent_row, n_components, pieces (NULL if a
    part's number is unknown), first and last component row.

    rows: by, order (consecutive integers), kind (PARENT, COMPONENT or other), quantity. Gaps and islands: a block's
    number is how many rows that are no component stand up to a row."""
    w = Window.partitionBy(*by).orderBy(order)
    block = F.sum(F.when(F.col("kind") == "COMPONENT", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.col(order) - F.lag(order, 1).over(w)
    marked = rows.withColumn("block", block).withColumn("broken", F.coalesce((gap != 1) & (F.col("kind") == "COMPONENT"), F.lit(False)))
    is_part = F.col("kind") == "COMPONENT"
    out = marked.groupBy(*by, "block").agg(F.max(F.when(F.col("kind") == "PARENT", F.col(order))).alias("parent_row"), F.count_if(is_part).alias("n_components"), F.when(F.count_if(is_part & F.col("quantity").isNull()) == 0, F.sum(F.when(is_part, F.col("quantity")))).alias("pieces"), F.min(F.when(is_part, F.col(order))).alias("first_row"), F.max(F.when(is_part, F.col(order))).alias("last_row"), F.bool_or("broken").alias("broken"))
    return out.where("parent_row is not null and n_components >= 2 and not broken").drop("block", "broken")


def evidence(term: Column, negated: Column, header: Column, parent_has_code: Column, valid_codes: Column, declared: Column, pieces: Column, pack: Column, price_agrees: Column) -> Column:
    """Points for and against a display."""
    points = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    return points(term, 4) + points(negated, -10) + F.lit(2) + points(header, 1) + points(~parent_has_code, 1) + points(valid_codes >= 2, 1) + points(declared == pieces, 2) + points(pack == pieces, 1) + points(price_agrees, 2)


def verdict(score: Column, term: Column, negated: Column, n_components: Column) -> Column:
    found = term & ~negated & (score >= 7) & (n_components >= 2)
    return F.when(found & (score >= 10), "HIGH").when(found, "MEDIUM").otherwise("NONE")


def compositions(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint, n_parts, pieces of each display: parts with one identifier are summed first, and an unknown
    number makes its sum unknown. parts: keys, ean, description, quantity."""
    name = F.coalesce(F.when(F.trim("ean") != "", F.col("ean")), F.col("description"))
    summed = parts.groupBy(*keys, name.alias("identifier")).agg(poisoned_sum(F.col("quantity")).alias("quantity"))
    pairs = F.collect_list(F.struct(F.coalesce("identifier", F.lit("")).alias("identifier"), F.coalesce(F.col("quantity").cast("string"), F.lit("?")).alias("quantity")))
    return summed.groupBy(*keys).agg(composition(pairs).alias("fingerprint"), F.count("*").alias("n_parts"), poisoned_sum(F.col("quantity")).alias("pieces"))


def same_displays(displays: DataFrame) -> DataFrame:
    """Displays of equal composition: fingerprint, n, n_suppliers, identical (more than one supplier has it)."""
    return displays.groupBy("fingerprint").agg(F.count("*").alias("n"), F.countDistinct("supplier").alias("n_suppliers")).withColumn("identical", F.col("n_suppliers") > 1)
