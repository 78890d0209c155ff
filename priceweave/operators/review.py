"""The review: saved answers laid over fresh offers, manual rows, carried decisions, and the order plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import MONEY


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], keep: list[str] = ()) -> DataFrame:
    """New rows replace or join old ones; columns in keep stay the old ones where there were any."""
    j = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in [*values, *keep]], F.lit(True).alias("__old")).join(new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in values], F.lit(True).alias("__new")), keys, "full_outer")
    taken = [F.when(F.col("__new"), F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c) for c in values]
    return j.select(*keys, *taken, *[F.col(f"__o_{c}").alias(c) for c in keep])


def overlay(base: DataFrame, overrides: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """base with the values that a user has set."""
    o = overrides.select(*keys, *[F.col(c).alias(f"__set_{c}") for c in values])
    rest = [c for c in base.columns if c not in values]
    return base.join(o, keys, "left").select(*rest, *[F.coalesce(f"__set_{c}", c).alias(c) for c in values])


def turn_off_rejected(offers: DataFrame, rejections: DataFrame) -> DataFrame:
    """available becomes false for offers whose supplier, product and article were rejected together; other offers of
    the same code then ask for confirmation. offers: product, supplier, article, code, available."""
    no = rejections.select("supplier", "product", "article").distinct().withColumn("__no", F.lit(True))
    j = offers.join(no, ["supplier", "product", "article"], "left").withColumn("rejected", F.coalesce("__no", F.lit(False))).drop("__no")
    tainted = F.max(F.col("rejected")).over(Window.partitionBy("product", "code"))
    return j.withColumn("available", F.col("available") & ~F.col("rejected")).withColumn("needs_confirmation", tainted & ~F.col("rejected"))


def confirmed(offers: DataFrame, answers: DataFrame) -> DataFrame:
    """offers with in_force: the current answer for the supplier and product is a yes to this very article."""
    a = answers.select("supplier", "product", F.col("article").alias("__article"), F.col("accepted").alias("__accepted"))
    yes = F.coalesce(F.col("__accepted") & (F.col("__article") == F.col("article")), F.lit(False))
    return offers.join(a, ["supplier", "product"], "left").withColumn("in_force", yes).drop("__article", "__accepted")


def unmatched_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: key, side."""
    j = left.select(key, F.lit(1).alias("__l")).distinct().join(right.select(key, F.lit(1).alias("__r")).distinct(), key, "full_outer")
    return j.where("__l is null or __r is null").select(key, F.when(F.col("__r").isNull(), "left").otherwise("right").alias("side"))


def append_missing(base: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """extra rows whose keys base lacks, behind base's."""
    return base.unionByName(extra.join(base.select(*keys), keys, "left_anti").select(*base.columns))


def carried(decisions: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """Saved decisions in a new comparison: identity, supplier, quantity, outcome. KEPT where product and offer are still
    there at the old price, RESET where the price changed, EXPIRED where either is gone.

    decisions: identity, supplier, quantity, price. products: identity. offers: identity, supplier, price."""
    p = products.select("identity", F.lit(True).alias("__p")).distinct()
    o = offers.select("identity", "supplier", F.col("price").alias("__price"))
    j = decisions.join(p, "identity", "left").join(o, ["identity", "supplier"], "left")
    gone = F.col("__p").isNull() | F.col("__price").isNull()
    return j.select("identity", "supplier", "quantity", F.when(gone, "EXPIRED").when(F.col("__price") != F.col("price"), "RESET").otherwise("KEPT").alias("outcome"))


def plan_errors(lines: DataFrame) -> DataFrame:
    """A row for each thing wrong with a line of the plan: source_row, error."""
    checks = {
        "no quantity": F.col("quantity").isNull(),
        "negative quantity": F.col("quantity") < 0,
        "no supplier": F.col("supplier").isNull() & (F.col("quantity") > 0),
        "no price": F.col("supplier").isNotNull() & ~F.coalesce(F.col("order_price") > 0, F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    return lines.select("source_row", F.explode(found).alias("error"))


def order_plan(lines: DataFrame, minimum: Column) -> DataFrame:
    """Per supplier: lines, total, and whether the order reaches the minimum; empty orders pass."""
    total = F.sum((F.col("quantity") * F.col("order_price")).cast(MONEY))
    summed = lines.where("quantity > 0 and supplier is not null").groupBy("supplier").agg(F.count("*").alias("n_lines"), total.alias("total"))
    return summed.withColumn("reaches", ~((F.col("total") > 0) & (F.col("total") < minimum)))


def threshold_notes(before: DataFrame, after: DataFrame, minimum: Column) -> DataFrame:
    """What a move does to each supplier's minimum: reached, lost, still below or unchanged. Both: supplier, total."""
    j = before.select("supplier", F.col("total").alias("b")).join(after.select("supplier", F.col("total").alias("a")), "supplier", "full_outer")
    below = lambda c: (F.coalesce(F.col(c), F.lit(0)) > 0) & (F.coalesce(F.col(c), F.lit(0)) < minimum)
    note = F.when(below("b") & ~below("a"), "reached").when(~below("b") & below("a"), "lost").when(below("b") & below("a"), "still below").otherwise("unchanged")
    return j.select("supplier", note.alias("note"))


def page_coverage(rows: DataFrame, page: str) -> DataFrame:
    """first, last, pages and missing: how many pages between the first and the last have no row."""
    a = rows.agg(F.min(page).alias("first"), F.max(page).alias("last"), F.countDistinct(page).alias("pages"))
    return a.withColumn("missing", F.col("last") - F.col("first") + 1 - F.col("pages"))


def repeated_codes(rows: DataFrame, code: str, description: str) -> DataFrame:
    """Codes on several rows: n, and whether a description repeats among them."""
    a = rows.groupBy(code).agg(F.count("*").alias("n"), F.countDistinct(F.lower(description)).alias("d"))
    return a.where("n > 1").select(code, "n", (F.col("d") < F.col("n")).alias("same_description"))


def around(rows: DataFrame, by: list[str], order: str, mark: str, before: int = 2, behind: int = 6) -> DataFrame:
    """Marked rows with the rows before and behind them."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-behind, before)
    return rows.where(F.lit(True)).withColumn("__near", F.max(F.col(mark).cast("int")).over(w)).where("__near = 1").drop("__near")


def head_middle_tail(rows: DataFrame, by: list[str], order: str, head: int = 12, middle: int = 5, tail: int = 12) -> DataFrame:
    """The first, middle and last rows of each sheet."""
    w = Window.partitionBy(*by)
    k, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    marked = rows.withColumn("__k", k).withColumn("__n", n)
    start = F.floor((F.col("__n") - middle) / 2)
    part = F.when(F.col("__k") <= head, "head").when(F.col("__k") > F.col("__n") - tail, "tail").when((F.col("__k") > start) & (F.col("__k") <= start + middle), "middle")
    return marked.withColumn("part", part).where("part is not null").drop("__k", "__n")


def previous_run(runs: DataFrame, current: str) -> DataFrame:
    """The latest completed run but the current one; ties by name. runs: name, state, started."""
    return runs.where((F.col("state") == "COMPLETED") & (F.col("name") != current) & F.col("started").isNotNull()).agg(F.max(F.struct("started", "name")).alias("r")).select("r.name", "r.started")


def answers_to_ask(cases: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """Cases that no valid remembered answer covers."""
    return cases.join(memory.where("valid").select(key).distinct(), key, "left_anti")


def effective_registry(shipped: DataFrame, learned: DataFrame) -> DataFrame:
    """The entry in use for each id: a learned one unless the shipped entry that it came from has changed.

    shipped: id, fingerprint, entry. learned: id, base_fingerprint, entry."""
    j = shipped.join(learned.select("id", "base_fingerprint", F.col("entry").alias("__learned")), "id", "full_outer")
    void = F.col("fingerprint").isNotNull() & (F.col("fingerprint") != F.col("base_fingerprint"))
    use = F.col("__learned").isNotNull() & ~F.coalesce(void, F.lit(False))
    return j.select("id", F.when(use, F.col("__learned")).otherwise(F.col("entry")).alias("entry"), F.when(use, "learned").otherwise("shipped").alias("origin")).where("entry is not null")
