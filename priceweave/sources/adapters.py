"""Declared layouts: a grid of cells becomes price-list records by native expressions that a mapping generates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators.aggregates import first_label


@dataclass
class Mapping:
    """columns: field -> column number from 1, letters, or the name of a header. filters and excludes: (field, pattern)
    and (label, field, pattern). Fields: ean, supplier_code, description, unit_price_pre, unit_price_net, discount,
    pieces_per_carton, order_multiplier, availability, packaging.

    required_headers: names that the header row must hold. multiplier_pattern: its first group is the multiplier in the
    order_multiplier cell, where that is a text such as "x 1,0"."""

    supplier: str
    columns: dict[str, int | str]
    header_row: int | None = None
    data_start: int = 1
    start_marker: tuple[int | str, str] | None = None
    marker_offset: int = 1
    italian: bool = False
    needs_pieces: bool = True
    filters: list[tuple[str, str]] = field(default_factory=list)
    excludes: list[tuple[str, str, str]] = field(default_factory=list)
    available_prefix: str | None = None
    required_headers: tuple[str, ...] = ()
    multiplier_pattern: str | None = None


def column_number(declared: int | str, header: list[str | None] | None = None) -> int:
    """A column from 1, by number, by letters, or by the one header that reads alike; none or several is an error."""
    if isinstance(declared, int):
        return declared
    if re.fullmatch(r"[A-Z]{1,3}", declared):
        n = 0
        for c in declared:
            n = n * 26 + ord(c) - 64
        return n
    plain = lambda s: re.sub(r"[^a-z0-9]+", "", (s or "").lower())
    found = [i for i, h in enumerate(header or [], 1) if plain(h) == plain(declared)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns read {declared!r}")
    return found[0]


#: Fields that a mapping can name.
FIELDS = ("ean", "supplier_code", "description", "unit_price_pre", "unit_price_net", "discount", "pieces_per_carton", "order_multiplier", "availability", "packaging")


def with_choices(mapping: Mapping, choices: dict[str, int | str | None], header: list[str | None] | None = None) -> Mapping:
    """The mapping with a user's columns over its own: field -> column, or None for a field that the list does not have.

    A column is a number, letters, or a name that one header of the list reads like. Unknown fields, columns that cannot be
    found and columns that two fields would take are errors, all named at once; nothing is guessed."""
    wrong = [f"{f}: no such field" for f in choices if f not in FIELDS]
    columns: dict[str, int] = {}
    for f, c in {**mapping.columns, **choices}.items():
        if f in FIELDS and c is not None:
            try:
                columns[f] = column_number(c, header)
            except ValueError as e:
                wrong.append(f"{f}: {e}")
    taken: dict[int, list[str]] = {}
    for f, n in columns.items():
        taken.setdefault(n, []).append(f)
    wrong += [f"column {n}: {' and '.join(fs)}" for n, fs in sorted(taken.items()) if len(fs) > 1 and any(f in choices for f in fs)]
    if header is not None:
        wrong += [f"{f}: column {n} of {len(header)}" for f, n in columns.items() if not 1 <= n <= len(header)]
    if wrong:
        raise ValueError(f"{mapping.supplier}: " + "; ".join(wrong))
    return replace(mapping, columns=columns)


def _cell(n: int) -> Column:
    return text.blank_to_null(F.get("cells", F.lit(n - 1)))


def start_of_data(grid: DataFrame, mapping: Mapping, marker_column: int) -> int:
    """The row behind the only row with the marker; none or several is an error."""
    rows = grid.where(F.lower(_cell(marker_column)) == mapping.start_marker[1].lower()).agg(F.min("source_row").alias("row"), F.count("*").alias("n")).first()
    if rows["n"] != 1:
        raise ValueError(f"{rows['n']} rows hold the marker {mapping.start_marker[1]!r}")
    return rows["row"] + mapping.marker_offset


def missing_headers(mapping: Mapping, header: list[str | None]) -> list[str]:
    plain = lambda s: re.sub(r"[^a-z0-9]+", "", (s or "").lower())
    there = {plain(h) for h in header}
    return [h for h in mapping.required_headers if plain(h) not in there]


class Counters:
    """What a reading met, filled by the pass that reads the rows: read, filtered (by the mapping's filters), no_product,
    kept, excluded by label, and unusable by reason. Known when an action over the records has ended."""

    def __init__(self) -> None:
        self.before, self.after = Observation(), Observation()

    def observed(self, rows: DataFrame, passed: Column) -> DataFrame:
        return rows.observe(self.before, F.count("*").alias("read"), F.count_if(~passed).alias("filtered"))

    def ended(self, out: DataFrame, mapping: Mapping, reasons: list[str], product: Column) -> DataFrame:
        counts = [F.count_if(~product).alias("no_product"), F.count_if(product & F.col("usable")).alias("kept")]
        for label, *_ in mapping.excludes:
            counts.append(F.count_if(product & F.col("excluded").eqNullSafe(label)).alias(f"excluded: {label}"))
        for reason in reasons:
            counts.append(F.count_if(product & F.col("excluded").isNull() & F.col("unusable_reason").eqNullSafe(reason)).alias(f"unusable: {reason}"))
        return out.observe(self.after, *counts)

    def values(self) -> dict[str, int]:
        return {**self.before.get, **self.after.get}


def records(grid: DataFrame, mapping: Mapping, counters: Counters | None = None) -> DataFrame:
    """Price-list records of a sheet, with usable and unusable_reason (NULL where usable); excluded rows keep their label
    in excluded, and rows that are no product are left out. A header row without the required headers is an error."""
    header = None
    if mapping.header_row:
        first = grid.where(F.col("source_row") == mapping.header_row).select("cells").first()
        header = list(first["cells"]) if first else []
        if absent := missing_headers(mapping, header):
            raise ValueError(f"{mapping.supplier}: the header row {mapping.header_row} lacks {', '.join(absent)}; it has {', '.join(h for h in header if h)}")
    at = {f: column_number(c, header) for f, c in mapping.columns.items()}
    start = start_of_data(grid, mapping, column_number(mapping.start_marker[0], header)) if mapping.start_marker else mapping.data_start
    null = F.lit(None).cast("string")
    value = lambda f: _cell(at[f]) if f in at else null
    rows = grid.where(F.col("source_row") >= start)
    passed = F.lit(True)
    for name, pattern in mapping.filters:
        passed = passed & F.coalesce(value(name).rlike(f"(?i){pattern}"), F.lit(False))
    rows = (counters.observed(rows, passed) if counters else rows).where(passed)
    times = value("order_multiplier")
    if mapping.multiplier_pattern:
        times = text.blank_to_null(F.regexp_extract(times, f"(?i){mapping.multiplier_pattern}", 1))
    pre, rate = numbers.number(value("unit_price_pre"), mapping.italian), F.coalesce(numbers.discount_rate(numbers.number(value("discount"), False)), F.lit(0).cast(numbers.RATE))
    out = rows.select(
        F.lit(mapping.supplier).alias("supplier"),
        "source_row",
        text.ean(value("ean")).alias("ean"),
        value("supplier_code").alias("supplier_code"),
        value("description").alias("description"),
        pre.alias("unit_price_pre"),
        rate.alias("discount_rate"),
        F.coalesce(numbers.number(value("unit_price_net"), mapping.italian), numbers.net(pre, rate)).alias("unit_price_net"),
        numbers.factor(F.coalesce(numbers.number(times, mapping.italian), numbers.number(value("pieces_per_carton"), mapping.italian))).alias("pieces_per_carton"),
        value("availability").alias("availability"),
        first_label([(label, F.coalesce(value(name).rlike(f"(?i){pattern}"), F.lit(False))) for label, name, pattern in mapping.excludes]).alias("excluded"),
    )
    product = F.coalesce("ean", "description", F.col("unit_price_pre").cast("string"), F.col("unit_price_net").cast("string")).isNotNull()
    reasons = [("no description", F.col("description").isNull()), ("no price", ~F.coalesce(F.col("unit_price_net") > 0, F.lit(False)))]
    if mapping.needs_pieces:
        reasons.append(("no pieces", F.col("pieces_per_carton").isNull()))
    if mapping.available_prefix:
        reasons.append(("not available", ~F.coalesce(F.startswith(F.lower("availability"), F.lit(mapping.available_prefix.lower())), F.lit(False))))
    out = out.withColumn("unusable_reason", first_label(reasons))
    out = out.withColumn("usable", F.col("unusable_reason").isNull() & F.col("excluded").isNull())
    return (counters.ended(out, mapping, [r for r, _ in reasons], product) if counters else out).where(product)
