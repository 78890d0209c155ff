"""Comparing two states: runs, cells, sets, page numbers, contiguous ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_drift(now: DataFrame, before: DataFrame, keys: list[str], rows_share: float = 0.15, price_share: float = 0.10) -> DataFrame:
    """Full outer join of two audits (keys, n_rows, price): verdict vanished, new, rows, price or steady. Shares are
    compared by multiplication."""
    j = now.select(*keys, F.col("n_rows").alias("rows_now"), F.col("price").alias("price_now")).join(before.select(*keys, F.col("n_rows").alias("rows_before"), F.col("price").alias("price_before")), keys, "full_outer")
    off = lambda a, b, s: F.abs(F.col(a) - F.col(b)) > F.col(b) * F.lit(s)
    verdict = F.when(F.col("rows_now").isNull(), "vanished").when(F.col("rows_before").isNull(), "new").when(off("rows_now", "rows_before", rows_share), "rows").when(off("price_now", "price_before", price_share), "price").otherwise("steady")
    return j.withColumn("verdict", verdict)


def cell_diff(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Cells that differ between two sheets in long form; a missing cell differs from any value."""
    j = a.select(*keys, F.col(value).alias("left")).join(b.select(*keys, F.col(value).alias("right")), keys, "full_outer")
    return j.where(~F.col("left").eqNullSafe(F.col("right")))


def contiguous(df: DataFrame, by: list[str], n: str) -> DataFrame:
    """Runs of consecutive integers: by, first, last, size."""
    rows = df.select(*by, n).distinct()
    island = F.col(n) - F.row_number().over(Window.partitionBy(*by).orderBy(n))
    return rows.withColumn("island", island).groupBy(*by, "island").agg(F.min(n).alias("first"), F.max(n).alias("last"), F.count("*").alias("size")).drop("island")


def missing_numbers(df: DataFrame, n: str, upto: int) -> DataFrame:
    """Numbers from 1 to upto that no row has."""
    return df.sparkSession.range(1, upto + 1).select(F.col("id").alias(n)).join(df.select(n).distinct(), n, "left_anti")


def first_occurrence(df: DataFrame, same: list, order: str) -> DataFrame:
    """The first row of those that are equal in the given columns, ignoring case."""
    keys = [F.lower(F.col(c).cast("string")).alias(f"__k{i}") for i, c in enumerate(same)]
    best = df.groupBy(*keys).agg(F.min(F.struct(order, *[c for c in df.columns if c != order])).alias("b"))
    return best.select("b.*").select(*df.columns)


def neighbours(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """value with that of the row before and behind."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("before", F.lag(value).over(w)).withColumn("behind", F.lead(value).over(w))


def separators(rows: DataFrame, by: list[str], order: str, cells: str = "nonempty") -> DataFrame:
    """Rows of one or two cells between rows of four or more."""
    n = neighbours(rows, by, order, cells)
    return n.where(F.col(cells).between(1, 2) & (F.col("before") >= 4) & (F.col("behind") >= 4))


def _drawn(what: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", what.cast("string"), F.lit(str(seed))))


def stratified_pages(df: DataFrame, page: str, k: int, seed: int) -> DataFrame:
    """slice (from 0) and one page of each of k equal slices of the numbers 1 to the last page, by a hash of page and seed;
    slices without pages have none. Grouped minima: no order over all pages."""
    last = df.agg(F.max(page).alias("__last"))
    # one row
    numbered = df.where(F.col(page) >= 1).join(F.broadcast(last))
    of = F.ceil(F.col(page) * F.least(F.lit(k), F.col("__last")) / F.col("__last")) - 1
    return numbered.groupBy(of.cast("int").alias("slice")).agg(F.min_by(page, _drawn(F.col(page), seed)).alias(page))


def targets(rows: DataFrame, pages: DataFrame, page: str, row: str, seed: int) -> DataFrame:
    """One row of each of these pages, by a hash of the row's key and seed."""
    rest = [c for c in rows.columns if c != page]
    best = rows.join(pages.select(page), page, "left_semi").groupBy(page).agg(F.min_by(F.struct(*rest), _drawn(F.col(row), seed)).alias("__row"))
    return best.select(page, "__row.*")


def spot_check(wanted: DataFrame, read_again: DataFrame, page: str, fields: list[str]) -> DataFrame:
    """wanted (page and fields) with n_rows (of the page when it was read again), n_equal and outcome: PASS where exactly
    one row of the page has the same fields, white space aside."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\s+", " "))
    key = F.sha2(F.concat_ws("\x1f", *[plain(f) for f in fields]), 256)
    pages = read_again.join(wanted.select(page).distinct(), page, "left_semi")
    counts = pages.groupBy(page).agg(F.count("*").alias("n_rows"))
    equal = pages.groupBy(page, key.alias("__key")).agg(F.count("*").alias("n_equal"))
    out = wanted.withColumn("__key", key).join(equal, [page, "__key"], "left").join(counts, page, "left").drop("__key")
    n = F.coalesce("n_equal", F.lit(0))
    return out.withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).withColumn("n_equal", n).withColumn("outcome", F.when(F.col("n_equal") == 1, "PASS").otherwise("FAIL"))
