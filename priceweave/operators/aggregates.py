"""Counts and statistics over sources, matches and warnings: grouped aggregation, partial before every shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_stats(prices: DataFrame) -> DataFrame:
    """Per supplier: rows, rows with a code, distinct codes, codes on several rows. Two levels, so no distinct expansion."""
    by_code = prices.groupBy("supplier", "ean").agg(F.count("*").alias("n"))
    has = F.col("ean").isNotNull() & (F.col("ean") != "")
    return by_code.groupBy("supplier").agg(F.sum("n").alias("n_rows"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_with_ean"), F.count_if(has).alias("n_eans"), F.count_if(has & (F.col("n") > 1)).alias("n_repeated"))


def price_stats(prices: DataFrame, price: str = "unit_price_net") -> DataFrame:
    """Per supplier: positive prices and their exact median."""
    return prices.where(F.col(price) > 0).groupBy("supplier").agg(F.count("*").alias("n_prices"), F.median(F.col(price).cast("double")).alias("median_price"))


def unusable_reasons(prices: DataFrame, reason: Column) -> DataFrame:
    return prices.where(~F.col("usable")).groupBy(F.coalesce(reason, F.lit("undeclared")).alias("reason")).agg(F.count("*").alias("n"))


def first_label(rules: list[tuple[str, Column]]) -> Column:
    """The label of the first rule that holds, or NULL."""
    out = F.lit(None).cast("string")
    for label, rule in reversed(rules):
        out = F.when(rule, F.lit(label)).otherwise(out)
    return out


def excluded_counts(rows: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """How many rows each exclusion rule takes (the first that holds), and how many stay."""
    return rows.groupBy(F.coalesce(first_label(rules), F.lit("kept")).alias("label")).agg(F.count("*").alias("n"))


def match_audit(matrix: DataFrame) -> DataFrame:
    """Per supplier: pairs by status."""
    names = ("EXACT", "AMBIGUOUS", "PRESENT_UNUSABLE", "ABSENT")
    return matrix.groupBy("supplier").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in names])


def missing_everywhere(matrix: DataFrame) -> DataFrame:
    """Products that no supplier lists."""
    return matrix.groupBy("source_row").agg(F.bool_and(F.col("status") == "ABSENT").alias("gone")).where("gone").select("source_row")


def why_missing(offers: DataFrame) -> DataFrame:
    """Per product without a usable offer, the reason: rejected by the user, not listed by anyone, or unavailable."""
    state = offers.groupBy("source_row").agg(F.bool_or(F.coalesce("usable", F.lit(False))).alias("any"), F.bool_or(F.coalesce("rejected", F.lit(False))).alias("no"), F.bool_and(F.col("status") == "ABSENT").alias("nowhere"))
    return state.where("not any").select("source_row", F.when(F.col("no"), "rejected").when(F.col("nowhere"), "not listed").otherwise("unavailable").alias("reason"))


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """All counts in one pass."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def poisoned_sum(value: Column) -> Column:
    """The sum, or NULL if any value is NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: non-empty cells, cells by kind, distinct values. One pass: columns become rows by stack."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, value)")
    kind = F.when(F.col("value").isNull() | (F.trim("value") == ""), "blank").when(F.col("value").rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), "number").when(F.lower("value").isin("true", "false"), "boolean").otherwise("text")
    return long.withColumn("kind", kind).groupBy("column_name").agg(F.count_if(F.col("kind") != "blank").alias("nonempty"), F.count_if(F.col("kind") == "number").alias("numbers"), F.count_if(F.col("kind") == "text").alias("texts"), F.count_if(F.col("kind") == "boolean").alias("booleans"), F.countDistinct("value").alias("distinct_values"))
