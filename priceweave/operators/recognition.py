"""Which declared layout a document has: containment of its required headers, and checks on its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import header_token
from .matching import small


def coverage(documents: DataFrame, adapters: DataFrame) -> DataFrame:
    """document_id, adapter_id, n_required, n_present, state: KNOWN (all required headers), NEAR (at most two missing,
    three present), VARIED, for pairs with a header in common.

    documents: document_id, headers. adapters: adapter_id, required. Headers are joined by value, and counts decide."""
    need = adapters.select("adapter_id", F.size("required").alias("n_required"), F.explode("required").alias("header"))
    have = documents.select("document_id", F.explode(F.array_distinct("headers")).alias("header"))
    met = have.join(small(need), "header").groupBy("document_id", "adapter_id", "n_required").agg(F.count("*").alias("n_present"))
    missing = F.col("n_required") - F.col("n_present")
    return met.withColumn("state", F.when(missing == 0, "KNOWN").when((missing <= 2) & (F.col("n_present") >= 3), "NEAR").otherwise("VARIED"))


def best_adapter(covered: DataFrame) -> DataFrame:
    """The adapter of the greatest share, most required headers, smallest id; AMBIGUOUS where two are complete and equal."""
    share = F.col("n_present") / F.col("n_required")
    best = covered.groupBy("document_id").agg(F.max(F.struct(share.alias("share"), F.col("n_required"))).alias("b"))
    tied = covered.withColumn("share", share).join(best, "document_id").where((F.col("share") == F.col("b.share")) & (F.col("n_required") == F.col("b.n_required")))
    return tied.groupBy("document_id").agg(F.min("adapter_id").alias("adapter_id"), F.first("state").alias("state"), F.count("*").alias("n_best")).select("document_id", "adapter_id", F.when((F.col("n_best") > 1) & (F.col("state") == "KNOWN"), "AMBIGUOUS").otherwise(F.col("state")).alias("state"))


def shape_score(profile: DataFrame, checks: DataFrame) -> DataFrame:
    """adapter_id, score, n_failed: weights of the column checks that a profile passes.

    profile: column_name, nonempty, numbers, texts. checks: adapter_id, column_name, least, kind (numbers or texts),
    share, weight. Shares are compared by multiplication."""
    j = small(checks).join(profile, "column_name", "left")
    of_kind = F.when(F.col("kind") == "numbers", F.col("numbers")).otherwise(F.col("texts"))
    ok = F.coalesce((F.col("nonempty") >= F.col("least")) & (of_kind > F.col("nonempty") * F.col("share")), F.lit(False))
    return j.groupBy("adapter_id").agg(F.sum(F.when(ok, F.col("weight")).otherwise(0)).alias("score"), F.count_if(~ok).alias("n_failed"))


def header_candidates(rows: DataFrame, keywords: list[str], top: int = 5) -> DataFrame:
    """Rows with a keyword, which may be the header: three points a different keyword, one a text cell up to eight; the
    best few.

    rows: row, cells. keywords: header tokens."""
    texts = F.filter("cells", lambda c: c.rlike("[A-Za-z]"))
    hits = F.size(F.array_intersect(F.transform("cells", header_token), F.array(*[F.lit(k) for k in keywords])))
    scored = rows.select("row", (3 * hits + F.least(F.size(texts), F.lit(8))).alias("score"), hits.alias("hits"))
    return scored.where("hits > 0").drop("hits").orderBy(F.desc("score"), "row").limit(top)


def rows_to_recognise(rows: DataFrame, keywords: list[str], first: int = 20) -> DataFrame:
    """The rows a registry may look for a header in: the first ones that are not empty, and header candidates below them.

    rows: row, cells."""
    head = rows.where(F.exists("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False)))).orderBy("row").limit(first)
    return head.select("row").unionByName(header_candidates(rows, keywords).select("row")).distinct().join(rows, "row")


def suggested_columns(headers: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, position: the column of each field that exactly one header names; the order's quantity takes the
    first of several.

    headers: keys, position, header. aliases: field, names (header tokens)."""
    names = aliases.select("field", F.explode("names").alias("__token")).distinct()
    hits = headers.select(*keys, "position", header_token(F.col("header")).alias("__token")).join(small(names), "__token")
    found = hits.groupBy(*keys, "field").agg(F.min("position").alias("position"), F.count("*").alias("n"))
    return found.where((F.col("n") == 1) | (F.col("field") == "order_quantity")).drop("n")


def dry_run(records: DataFrame, keys: list[str], least_share: float = 0.0) -> DataFrame:
    """keys, rows_read, rows_usable, rows_discarded, ok: whether a mapping gives usable rows, one at least and the share
    asked for. records: keys, usable."""
    n, u = F.count("*"), F.count_if("usable")
    return records.groupBy(*keys).agg(n.alias("rows_read"), u.alias("rows_usable"), (n - u).alias("rows_discarded"), (u >= F.greatest(F.lit(1.0), n * least_share)).alias("ok"))


def layout_checks(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """observed with columns_ok, header_row_ok, sheet_ok and data_rows_ok; what a layout does not declare holds.

    observed: adapter_id, headers (tokens), max_column, header_row, sheet, max_row. declared: adapter_id, named, numbered
    (columns by name and by number), wanted_header_row, wanted_sheet, data_start; all but the id may be NULL."""
    j = observed.join(small(declared), "adapter_id")
    no_names, no_numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    named = F.transform(F.coalesce("named", no_names), header_token)
    columns = (F.size(F.array_except(named, F.coalesce("headers", no_names))) == 0) & F.forall(F.coalesce("numbered", no_numbers), lambda n: n <= F.col("max_column"))
    same = lambda wanted, seen: wanted.isNull() | F.coalesce(wanted == seen, F.lit(False))
    data = F.col("data_start").isNull() | F.coalesce(F.col("max_row") >= F.col("data_start"), F.lit(False))
    return j.withColumn("columns_ok", columns).withColumn("header_row_ok", same(F.col("wanted_header_row"), F.col("header_row"))).withColumn("sheet_ok", same(header_token(F.col("wanted_sheet")), header_token(F.col("sheet")))).withColumn("data_rows_ok", data)
