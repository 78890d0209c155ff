"""Accounting of a run: reports, checks of sets, the order history and prices of displays. All are native plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
#: fixed values: rows that a report cites, the score from which a reject is suspicious, days that expired orders are shown
CITED_ROWS = 6
SUSPICIOUS = 0.65
NOTICE_DAYS = 30


# reports


def cited_rows(rows: Column) -> Column:
    """The first rows of a sorted array, then how many more there are."""
    first = F.array_join(F.transform(F.slice(rows, 1, CITED_ROWS), lambda r: r.cast("string")), ", ")
    return F.when(F.size(rows) > CITED_ROWS, F.concat(first, F.lit(" +"), (F.size(rows) - CITED_ROWS).cast("string"))).otherwise(first)


def warnings_summary(warnings: DataFrame) -> DataFrame:
    """supplier, kind (what stands before the first colon), n, n_price. warnings: supplier, text, affects_price."""
    kind = F.trim(F.substring_index("text", ":", 1)).alias("kind")
    return warnings.groupBy("supplier", kind).agg(F.count("*").alias("n"), F.count_if("affects_price").alias("n_price"))


def promotion_counts(promotions: DataFrame) -> DataFrame:
    """Of each supplier the promotions read, in the price, actionable and unlinked. promotions: supplier, applied,
    actionable, n_products."""
    return promotions.groupBy("supplier").agg(F.count("*").alias("n_read"), F.count_if("applied").alias("n_in_price"), F.count_if(F.col("actionable") & ~F.col("applied")).alias("n_actionable"), F.count_if(F.col("n_products") == 0).alias("n_unlinked"))


def destination_rows(lines: DataFrame) -> DataFrame:
    """The quantity that each row of a supplier's document gets: supplier, row, quantity."""
    return lines.groupBy("supplier", "row").agg(F.sum("quantity").alias("quantity"))


def phase_report(cases: DataFrame) -> DataFrame:
    """One row: cases with and without candidates, decided by action, undecided, and whether more than half failed.
    cases: n_candidates, action (NULL if undecided), failed."""
    asked = F.col("n_candidates") > 0
    counts = [F.count_if(asked & (F.col("action") == a)).alias(f"n_{a.lower()}") for a in ("ACCEPT", "REJECT", "UNRESOLVED")]
    return cases.agg(F.count("*").alias("n_cases"), F.count_if(~asked).alias("n_without"), *counts, F.count_if(asked & F.col("action").isNull()).alias("n_undecided"), (F.count_if("failed") * 2 > F.count("*")).alias("degraded"))


def case_scores(shortlist: DataFrame) -> DataFrame:
    """qid, supplier, best score and number of candidates."""
    return shortlist.groupBy("qid", "supplier").agg(F.max("score").alias("best_score"), F.count("*").alias("n_candidates"))


def suspicious_rejects(decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """Rejected cases whose best candidate scores SUSPICIOUS or more. decisions: qid, supplier, action."""
    rejected = decisions.where(F.col("action") == "REJECT")
    return rejected.join(scores.where(F.col("best_score") >= SUSPICIOUS), ["qid", "supplier"]).select("qid", "supplier", "best_score")


def product_warnings(products: DataFrame) -> DataFrame:
    """One row: products without a usable offer and with a suspicious reject, and those of each that are wanted.
    products: n_offers, n_suspicious, quantity."""
    none, odd, wanted = F.col("n_offers") == 0, F.col("n_suspicious") > 0, F.col("quantity") > 0
    return products.agg(F.count_if(none).alias("n_without"), F.count_if(none & wanted).alias("n_without_wanted"), F.count_if(odd).alias("n_suspicious"), F.count_if(odd & wanted).alias("n_suspicious_wanted"))


def supplier_order(*tables: DataFrame, preferred: list[str]) -> DataFrame:
    """supplier, position: all suppliers of the tables, the preferred ones first, the others by name."""
    found = tables[0].select("supplier")
    for t in tables[1:]:
        found = found.unionByName(t.select("supplier"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("supplier")).cast("int"), F.lit(0))
    order = Window.orderBy(F.when(rank > 0, rank).otherwise(F.lit(len(preferred) + 1)), "supplier")
    # a row for each supplier: the one window over all is as small as the list of suppliers
    return found.distinct().select("supplier", F.row_number().over(order).alias("position"))


def unpriced_suppliers(prices: DataFrame) -> DataFrame:
    """Suppliers that have rows and no positive median price. prices: supplier, price."""
    stats = prices.groupBy("supplier").agg(F.count("*").alias("n_rows"), F.median("price").alias("median_price"))
    return stats.where(F.col("median_price").isNull() | (F.col("median_price") <= 0)).select("supplier", "n_rows")


# checks of sets


def header_differences(observed: Column, required: Column, declared: Column) -> Column:
    """struct<unknown, missing>: headers that are not declared, and required ones that are not there; both sorted."""
    return F.struct(F.array_sort(F.array_except(observed, declared)).alias("unknown"), F.array_sort(F.array_except(required, observed)).alias("missing"))


def split_cases(cases: DataFrame, shortlist: DataFrame) -> DataFrame:
    """cases with n_candidates, and repeated: whether the pair is asked more than once, which is an error."""
    found = shortlist.groupBy("qid", "supplier").agg(F.count("*").alias("n"))
    asked = cases.groupBy("qid", "supplier").agg((F.count("*") > 1).alias("repeated"))
    return asked.join(found, ["qid", "supplier"], "left").select("qid", "supplier", F.coalesce("n", F.lit(0)).alias("n_candidates"), "repeated")


def other_provenance(decisions: DataFrame, model: str, prompt: str) -> DataFrame:
    """Decisions by another model or prompt than the run's, by both."""
    other = ~(F.col("model").eqNullSafe(model) & F.col("prompt").eqNullSafe(prompt))
    return decisions.where(other).groupBy("model", "prompt").agg(F.count("*").alias("n"))


def count_differences(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, declared, found where a declared number is not the number of rows found, or one side is absent."""
    there = found.groupBy(key).agg(F.count("*").alias("found"))
    return declared.join(there, key, "full").where(~F.col("declared").eqNullSafe(F.col("found"))).select(key, "declared", "found")


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """code, file: no or several masters, a supplier twice, contents that are not those declared, unmapped files.
    manifest: file, role, supplier, declared_sha, sha, mapped."""
    masters = manifest.where("role = 'MASTER'")
    many = masters.agg(F.count("*").alias("n")).where("n <> 1").select(F.when(F.col("n") == 0, "NO_MASTER").otherwise("SEVERAL_MASTERS").alias("code"), F.lit(None).cast("string").alias("file"))
    twice = manifest.where("supplier is not null").groupBy("supplier").agg(F.count("*").alias("n"), F.max("file").alias("file")).where("n > 1").select(F.lit("SUPPLIER_TWICE").alias("code"), "file")
    changed = manifest.where(~F.col("sha").eqNullSafe(F.col("declared_sha"))).select(F.lit("CHANGED").alias("code"), "file")
    unmapped = manifest.where(~F.col("mapped")).select(F.lit("UNMAPPED").alias("code"), "file")
    return many.unionByName(twice).unionByName(changed).unionByName(unmapped)


def only_row(candidates: DataFrame) -> DataFrame:
    """source_row, supplier, row: the row of the only candidate over all codes; NULL where several rows are."""
    return candidates.groupBy("source_row", "supplier").agg(F.when(F.min("row") == F.max("row"), F.min("row")).alias("row"))


# order history


def order_totals(lines: DataFrame) -> DataFrame:
    """supplier, n_lines, total (two decimals)."""
    return lines.groupBy("supplier").agg(F.count("*").alias("n_lines"), F.round(F.sum("amount"), 2).alias("total"))


def record_plan(history: DataFrame, plan: DataFrame, run_id: str, delivered: DataFrame | None = None) -> DataFrame:
    """history after a plan. Orders of the delivered suppliers (column supplier; those of the plan if not given) are
    recorded: new ones are pending, known ones take the plan's values and keep their moment and state. Of these suppliers,
    pending orders of the same run that are not recorded go, as the new ones replace them; other suppliers' orders stay,
    whether the plan holds them or not. Suppliers are compared without case.

    Both: order_id, run_id, supplier, status, total, created_at."""
    name = lambda c: F.lower(F.trim(c))
    sent = (plan if delivered is None else delivered).select(name(F.col("supplier")).alias("__sent")).where("__sent <> ''").distinct()
    new = plan.join(sent, name(F.col("supplier")) == F.col("__sent"), "left_semi").alias("p")
    old = history.join(sent, name(F.col("supplier")) == F.col("__sent"), "left").alias("h")
    joined = old.join(new, F.col("h.order_id") == F.col("p.order_id"), "full")
    replaced = F.col("p.order_id").isNull() & (F.col("h.run_id") == run_id) & (F.col("h.status") == "pending") & F.col("h.__sent").isNotNull()
    take = lambda c: F.coalesce(f"p.{c}", f"h.{c}").alias(c)
    kept = joined.where(~F.coalesce(replaced, F.lit(False)))
    return kept.select(take("order_id"), take("run_id"), take("supplier"), F.coalesce("h.status", F.lit("pending")).alias("status"), take("total"), F.coalesce("h.created_at", "p.created_at").alias("created_at"))


def answered_status(status: Column, received: Column) -> Column:
    """The state after an answer: yes makes it received; no keeps it pending, or expired if it was."""
    return F.when(received, "received").when(status == "expired", status).when(~received, "pending").otherwise(status)


def closed_status(status: Column) -> Column:
    """Closed as never to arrive, whatever the state was; NULL stays NULL."""
    return F.when(status.isNotNull(), F.lit("closed"))


def without_compilation(history: DataFrame, order_key: str) -> DataFrame:
    """history without the orders of a compilation, whose ids are its key, a colon and the supplier; an empty key is none."""
    key = (order_key or "").strip()
    return history.where(~F.coalesce(F.startswith("order_id", F.lit(key + ":")), F.lit(False))) if key else history


def expired_lately(history: DataFrame, now: Column, days: int = NOTICE_DAYS) -> DataFrame:
    """Orders that expired within the last days, up to now."""
    at = F.col("expired_at")
    return history.where((F.col("status") == "expired") & (at > now - F.make_interval(days=F.lit(days))) & (at <= now))


# orders of rows


def by_reach(states: DataFrame) -> DataFrame:
    """states (promotion_id, status, remaining) with their position: earned, near and the others, the nearest first."""
    rank = F.when(F.col("status") == "EARNED", 0).when(F.col("status") == "NEAR", 1).otherwise(2)
    return states.orderBy(rank, "remaining", "promotion_id")


def move_order() -> list[Column]:
    """Sort keys of move options: most lines moved, the least cost a piece, id."""
    return [F.desc("n_lines"), F.asc("delta_per_piece"), F.asc("supplier")]


def line_numbers(records: DataFrame, file: str, lines: str, order: str) -> DataFrame:
    """records with first_line, the physical line that each starts on: records of a file hold so many lines each."""
    before = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("first_line", F.coalesce(F.sum(lines).over(before), F.lit(0)) + 1)


# displays


def component_economics(pieces: Column, unit_price: Column, rate: Column) -> Column:
    """struct<pre, post>: a component's price in its display, before and after its discount."""
    pre = (pieces * unit_price).cast(MONEY)
    return F.struct(pre.alias("pre"), (pre * (F.lit(1) - F.coalesce(rate, F.lit(0)))).cast(MONEY).alias("post"))


def with_displays(records: DataFrame, classes: DataFrame) -> DataFrame:
    """records (source_row, unit_price, pack, usable) with row_type, display_price and what is usable: components are
    not, and a display needs its pack. classes: source_row, row_type, reconciled."""
    j = records.join(classes, "source_row", "left").withColumn("row_type", F.coalesce("row_type", F.lit("STANDARD")))
    display = F.col("row_type") == "DISPLAY"
    price = F.when(display, (F.col("unit_price") * F.col("pack")).cast(MONEY))
    usable = F.col("usable") & (F.col("row_type") != "COMPONENT") & ~(display & F.col("pack").isNull())
    return j.select("source_row", "row_type", price.alias("display_price"), usable.alias("usable"), F.coalesce("reconciled", F.lit(False)).alias("reconciled"))


def display_piece_price(net: Column, declared: Column) -> Column:
    return (net / F.when(declared > 0, declared).otherwise(1)).cast(MONEY)


def identical_displays(a: Column, b: Column, reconciled_a: Column, reconciled_b: Column) -> Column:
    """Whether two displays are the same: equal fingerprints, both known to be reconciled."""
    return F.coalesce((a == b) & reconciled_a.eqNullSafe(True) & reconciled_b.eqNullSafe(True), F.lit(False))


def flat_displays(by_supplier: DataFrame) -> DataFrame:
    """supplier and display, a row for each. by_supplier: supplier, displays (an array of structs)."""
    return by_supplier.select("supplier", F.explode("displays").alias("display")).select("supplier", "display.*")


# amounts


def comparable_price(text: Column) -> Column:
    """A price of any writing with six decimals, for comparing."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("decimal(18,6)")


def order_amount(cartons: Column, factor: Column, unit_price: Column, order_price: Column) -> Column:
    """struct<pieces, total, per_piece> of a wanted number of cartons; a piece costs the order price by its factor where
    it has no price of its own."""
    piece = F.coalesce(unit_price, (order_price / factor).cast(MONEY))
    return F.struct((cartons * factor).cast(MONEY).alias("pieces"), (cartons * F.coalesce(order_price, unit_price * factor)).cast(MONEY).alias("total"), piece.alias("per_piece"))


def cartons_for(pieces: Column, factor: Column) -> Column:
    return F.when(factor > 0, F.ceil(pieces / factor))


def minimum_order(suppliers: DataFrame, minimums: DataFrame) -> DataFrame:
    """suppliers with their minimum order, 0 if none is declared."""
    return suppliers.join(minimums, "supplier", "left").withColumn("minimum", F.coalesce("minimum", F.lit(0).cast(MONEY)))


def chosen(own: Column, override: Column) -> Column:
    """A quantity, overridden if something is given; never under 0."""
    return F.greatest(F.coalesce(override, own), F.lit(0))


# texts and moments


def moment(text: Column) -> Column:
    """An ISO moment in the session's time zone (UTC); NULL if unreadable."""
    return F.try_to_timestamp(F.trim(text))


def expiry_of(description: Column, pattern: str, now_year: int | Column, back: int = 2, ahead: int = 10) -> Column:
    """struct<text, raw, expires, plausible>: a description without its first date of expiry (pattern: day, month, year, in
    any case), that fragment, its date (NULL where the calendar has none) and whether its year is near. Without a fragment
    the description stays and the rest is NULL."""
    any_case = F.lit("(?i)" + pattern)
    at, raw = F.regexp_instr(description, any_case), F.regexp_substr(description, any_case)
    part = lambda k: F.regexp_extract(raw, "(?i)" + pattern, k)
    date = F.try_to_date(F.concat_ws("-", F.lpad(part(3), 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")
    year = now_year if isinstance(now_year, Column) else F.lit(now_year)
    there = raw.isNotNull()
    rest = F.concat(F.substring(description, F.lit(1), at - 1), F.substring(description, at + F.char_length(raw), F.char_length(description)))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    near = F.coalesce(F.year(date).between(year - back, year + ahead), F.lit(False))
    return F.struct(F.when(there, strip(rest)).otherwise(description).alias("text"), strip(raw).alias("raw"), F.when(there, date).alias("expires"), F.when(there, near).alias("plausible"))


def display_names(declared: DataFrame) -> DataFrame:
    """supplier, name: the shortest declared one, else the id made readable."""
    readable = F.initcap(F.replace("supplier", F.lit("_"), F.lit(" ")))
    return declared.groupBy("supplier").agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.struct(F.length("name"), F.col("name")))).alias("name")).select("supplier", F.coalesce("name", readable).alias("name"))
