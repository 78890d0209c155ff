"""Conditions that documents declare: row codes, promotions laid out in rows or blocks, displays on a single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fingerprints
from ..functions.numbers import MONEY
from ..functions.text import plain_text
from .matching import small
from .promotions import GIVEN, VERBS, parse_text

#: fixed values: kinds and certainties of a promotion, rows that an open block may have, and what is said of one that
#: cannot be read
KINDS = ("THRESHOLD_GIFT", "INCLUDED_PACK", "NUMERIC_DISCOUNT", "REVIEW")
CERTAINTIES = ("CERTAIN", "LIKELY", "REVIEW")
BLOCK_ROWS = 500
NO_HEADING, NEXT_HEADING, NO_REWARD, SHEET_ENDS, NO_THRESHOLD = "NO_HEADING", "NEXT_HEADING", "NO_REWARD", "SHEET_ENDS", "NO_THRESHOLD"


def is_heading(text: Column) -> Column:
    """A verb of buying and a number open a threshold, whatever unit follows."""
    return F.coalesce(plain_text(text).rlike(rf"\b(?:{VERBS})\s+\d"), F.lit(False))


def is_reward(text: Column) -> Column:
    """A phrase of giving; the name of the gift may stand elsewhere."""
    return F.coalesce(plain_text(text).rlike(rf"\b(?:{GIVEN})\b"), F.lit(False))


def _code(c: Column) -> Column:
    return F.upper(F.trim(c))


def marked_rows(records: DataFrame, codes: DataFrame, reward_type: str | None = None) -> DataFrame:
    """records with row_type and not_orderable_reason; rows that a declared code or, with reward_type, the text of a
    reward marks are no longer usable. A code that says so goes before the text.

    records: row_code, description, usable. codes: code, orderable, row_type, means."""
    declared = codes.where(~F.col("orderable")).groupBy(_code(F.col("code")).alias("__code")).agg(F.min(F.struct("row_type", "means")).alias("__mark"))
    out = records.join(small(declared), _code(F.col("row_code")) == F.col("__code"), "left").drop("__code")
    gift = is_reward(F.col("description")) if reward_type else F.lit(False)
    coded = F.col("__mark").isNotNull()
    kind = F.when(coded, F.coalesce("__mark.row_type", F.lit("NOT_ORDERABLE"))).when(gift, F.lit(reward_type))
    reason = F.when(coded, F.coalesce("__mark.means", F.lit(""))).when(gift, "reward")
    return out.withColumn("row_type", kind).withColumn("not_orderable_reason", reason).withColumn("usable", F.col("usable") & kind.isNull()).drop("__mark")


def row_conditions(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """supplier, first_row, last_row, eligible_rows, reason and the parsed text of sheets with a condition on a row.

    rows: supplier, row, text, row_code. Rows whose code is not orderable have none."""
    gone = codes.where(~F.col("orderable")).select("supplier", _code(F.col("code")).alias("__code")).distinct()
    kept = rows.withColumn("__code", _code(F.coalesce("row_code", F.lit("")))).join(small(gone), ["supplier", "__code"], "left_anti")
    parsed = kept.select("supplier", F.col("row").alias("first_row"), F.col("row").alias("last_row"), F.array("row").alias("eligible_rows"), F.col("text").alias("source_text"), F.lit(None).cast("string").alias("reason"), parse_text(F.col("text")).alias("p"))
    return parsed.where("p is not null").select("*", "p.*").drop("p")


def block_conditions(rows: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """The conditions of sheets that write a heading, the rows it is for, and the reward below them: supplier,
    first_row, last_row, eligible_rows, source_text, reason (why a block cannot be computed, NULL if it can), kind,
    threshold, threshold_unit, reward, reward_unit, reward_text.

    rows: supplier, row, text, reward_name, ean, orderable. A block ends at its reward, at the next heading, at the end
    of the sheet, or at a row over `most` rows below the heading that is no product. Rewards outside of a block and
    blocks without one are reported, never lost. Windows are those of a sheet, whose size is bounded by its format."""
    of_sheet = Window.partitionBy("supplier").orderBy("row")
    of_block = Window.partitionBy("supplier", "block")
    r = rows.withColumn("heading", is_heading(F.col("text"))).withColumn("gift", ~F.col("heading") & is_reward(F.col("text")))
    r = r.withColumn("eligible", ~F.col("heading") & ~F.col("gift") & F.coalesce((F.trim("ean") != "") & F.col("orderable"), F.lit(False)))
    r = r.withColumn("block", F.sum(F.col("heading").cast("int")).over(of_sheet)).withColumn("start", F.max(F.when(F.col("heading"), F.col("row"))).over(of_block))
    far = ~F.col("eligible") & ~F.col("heading") & (F.col("row") - F.col("start") > most)
    r = r.withColumn("close", F.min(F.when(F.col("start").isNotNull() & (F.col("gift") | far), F.col("row"))).over(of_block))
    spoken = lambda *c: F.concat_ws(" ", *[F.when(F.trim(x) != "", F.trim(x)) for x in c])
    none = F.lit(None).cast("string")
    orphans = r.where(F.col("gift") & (F.col("start").isNull() | (F.col("row") > F.col("close"))))
    orphans = orphans.select("supplier", F.col("row").alias("first_row"), F.col("row").alias("last_row"), F.array().cast("array<long>").alias("eligible_rows"), spoken("text", "reward_name").alias("source_text"), F.lit(NO_HEADING).alias("reason"))
    inside = r.where(F.col("start").isNotNull() & (F.col("close").isNull() | (F.col("row") <= F.col("close"))))
    at_close = lambda c: F.max(F.when(F.col("gift") & (F.col("row") == F.col("close")), F.coalesce(c, F.lit(""))))
    blocks = inside.groupBy("supplier", "block", "start", "close").agg(
        F.max(F.when(F.col("heading"), F.col("text"))).alias("head"),
        F.array_sort(F.collect_list(F.when(F.col("eligible"), F.col("row").cast("long")))).alias("eligible_rows"),
        at_close(F.col("text")).alias("gift_text"),
        at_close(F.col("reward_name")).alias("gift_name"),
        F.max("row").alias("end"),
    )
    after = F.lead("start").over(Window.partitionBy("supplier").orderBy("block"))
    blocks = blocks.withColumn("next", after).withColumn("source_text", spoken(F.col("head"), F.coalesce("gift_text", none), F.coalesce("gift_name", none)))
    blocks = blocks.withColumn("p", F.when(F.col("gift_text").isNotNull(), parse_text(F.col("source_text"))))
    reason = F.when(F.col("gift_text").isNotNull(), F.when(F.coalesce(F.col("p.kind") == "THRESHOLD_GIFT", F.lit(False)), none).otherwise(NO_THRESHOLD)).when(F.col("close").isNotNull(), NO_REWARD).when(F.col("next").isNotNull(), NEXT_HEADING).otherwise(SHEET_ENDS)
    last = F.coalesce("close", F.col("next") - 1, "end")
    blocks = blocks.select("supplier", F.col("start").alias("first_row"), last.alias("last_row"), "eligible_rows", "source_text", reason.alias("reason"), "p")
    out = blocks.unionByName(orphans, allowMissingColumns=True)
    fields = ("threshold", "threshold_unit", "reward", "reward_unit", "reward_text")
    sure = F.col("reason").isNull()
    return out.select("supplier", "first_row", "last_row", "eligible_rows", "source_text", "reason", F.when(sure, F.col("p.kind")).otherwise("REVIEW").alias("kind"), *[F.when(sure, F.col(f"p.{f}")).alias(f) for f in fields])


def promotion_id(supplier: Column, reference: Column, kind: Column, text: Column) -> Column:
    return fingerprints.digest(supplier, reference, kind, text, size=16)


def combined(*sources: DataFrame) -> DataFrame:
    """All promotions of a run once each, by promotion_id; equal ids are the same promotion.

    Each: supplier, source_reference, kind, source_text, already_applied."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    key = promotion_id(F.col("supplier"), F.col("source_reference"), F.col("kind"), F.col("source_text"))
    return out.withColumn("promotion_id", key).groupBy("promotion_id").agg(*[F.max(c).alias(c) for c in ("supplier", "source_reference", "kind", "source_text", "already_applied")])


def not_in_price(promotions: DataFrame) -> DataFrame:
    """Promotions that change a decision: discounts that the price holds already go."""
    return promotions.where(~((F.col("kind") == "NUMERIC_DISCOUNT") & F.coalesce("already_applied", F.lit(False))))


def contract(promotions: DataFrame) -> DataFrame:
    """promotions with an error (NULL where the contract holds) and safe effects: only a confirmed, active, certain
    numeric discount moves totals or the choice of a supplier, and only such a kind has a rate.

    promotions: supplier, source_reference, kind, certainty, confirmed, deterministic, active, affects_total,
    affects_supplier_choice, discount_rate."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    other = lambda c, known: ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    error = F.when(blank("supplier"), "NO_SUPPLIER").when(blank("source_reference"), "NO_REFERENCE").when(other("kind", KINDS), "KIND").when(other("certainty", CERTAINTIES), "CERTAINTY")
    numeric = F.coalesce(F.col("kind") == "NUMERIC_DISCOUNT", F.lit(False))
    safe = F.coalesce(numeric & (F.col("certainty") != "REVIEW") & F.col("confirmed") & F.col("deterministic") & F.col("active"), F.lit(False))
    out = promotions.withColumn("error", error).withColumn("discount_rate", F.when(numeric, F.col("discount_rate")))
    for c in ("affects_total", "affects_supplier_choice"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(False)) & safe)
    return out


def declared_units(text: Column, pattern: str) -> Column:
    """The sum of the numbers in the first match of a pattern; NULL without a match or a number."""
    found = F.regexp_extract_all(F.regexp_substr(text, F.lit(f"(?i){pattern}")), F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    numbers = F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(".")).cast(MONEY))
    total = F.aggregate(numbers, F.lit(0).cast(MONEY), lambda a, x: (a + x).cast(MONEY))
    return F.when(F.size(numbers) > 0, total)


def standalone_displays(records: DataFrame, name: str, exclude: str | None = None, code: str | None = None, factor: float | None = None, units: str | None = None) -> DataFrame:
    """records with display (DISPLAY, REJECTED for a name that another rule turns down, STANDARD), declared_units and,
    for displays, whether they can be ordered and why not.

    name, exclude, code and units: patterns over description, supplier_code and description. A display is never more
    usable than its row. records: description, supplier_code, order_multiplier, pieces_per_carton, usable,
    unusable_reason."""
    text, no = F.trim(F.coalesce("description", F.lit(""))), F.lit(False)
    has = lambda c, p: F.coalesce(c.rlike(f"(?i){p}"), no)
    raw = F.coalesce("order_multiplier", "pieces_per_carton")
    pieces = F.when(raw > 0, raw)
    down = has(text, exclude) if exclude else no
    if code:
        down = down | ~has(F.trim(F.coalesce("supplier_code", F.lit(""))), code)
    if factor is not None:
        down = down | ~F.coalesce(pieces == factor, no)
    display = F.when(~has(text, name), "STANDARD").when(down, "REJECTED").otherwise("DISPLAY")
    why = F.when(~F.coalesce("usable", F.lit(True)), F.coalesce("unusable_reason", F.lit("not stated"))).when(pieces.isNull(), "no pieces")
    shown = F.col("display") == "DISPLAY"
    out = records.withColumn("display", display).withColumn("__why", why)
    out = out.withColumn("declared_units", F.when(shown, declared_units(text, units)) if units else F.lit(None).cast(MONEY))
    return out.withColumn("unusable_reason", F.when(shown, F.col("__why")).otherwise(F.col("unusable_reason"))).withColumn("usable", F.when(shown, F.col("__why").isNull()).otherwise(F.col("usable"))).drop("__why")


def orderable(code: Column, indicator: Column, description: Column, price: Column) -> Column:
    """A row of a display sheet that can be ordered: a code, or an indicator with a name and a price."""
    there = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return there(code) | (there(indicator) & there(description) & price.isNotNull())


def component_text(cells: Column, first: int = 7, last: int = 14) -> Column:
    """The first cell with a letter from column `first` to `last`, counted from 1; NULL without one."""
    return F.get(F.filter(F.slice(cells, first, last - first + 1), lambda c: F.coalesce(c.rlike(r"\p{L}"), F.lit(False))), F.lit(0))


def component_quantity(cells: Column, first: int = 8, last: int = 14) -> Column:
    """The first positive whole number from column `first` to `last`, counted from 1; NULL without one."""
    whole = lambda c: F.coalesce(c.rlike(r"^\s*0*[1-9][0-9]{0,8}(\.0+)?\s*$"), F.lit(False))
    found = F.get(F.filter(F.slice(cells, first, last - first + 1), whole), F.lit(0))
    return F.trim(found).cast("decimal(18,4)").cast("int")


def component_candidate(can_be_ordered: Column, cells: Column, ean: Column) -> Column:
    """A row that is not ordered itself and has a name and a code or a number of pieces."""
    known = F.coalesce(F.trim(ean) != "", F.lit(False)) | component_quantity(cells).isNotNull()
    return ~can_be_ordered & component_text(cells).isNotNull() & known
