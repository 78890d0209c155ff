"""Numbers as price lists write them: unreadable is NULL, never a default."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, RATE = "decimal(18,4)", "decimal(9,4)"

# fixed values: units of thresholds and what they are read as
UNITS = {"CT": "CARTONS", "CRT": "CARTONS", "CARTONE": "CARTONS", "CARTONI": "CARTONS", "COLLO": "CARTONS", "COLLI": "CARTONS", "CL": "CARTONS", "PZ": "PIECES", "PEZZO": "PIECES", "PEZZI": "PIECES"}


def money(c: Column) -> Column:
    """Four decimals, half up."""
    return c.cast(MONEY)


def cents(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def number(text: Column, italian: bool = False) -> Column:
    """A decimal, or NULL where the text is none. Italian: points part thousands and a comma starts the decimals, so one
    point before one or two digits could be either and is not read."""
    t = F.trim(text)
    if italian:
        doubtful = t.rlike(r"^[-+]?\d+\.\d{1,2}$")
        return F.when(~doubtful, F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".").try_cast(MONEY))
    return t.try_cast(MONEY)


def strict_italian_price(text: Column) -> Column:
    ok = F.trim(text).rlike(r"^\d{1,3}(\.\d{3})*,\d{1,4}$|^\d+(,\d{1,4})?$")
    return F.when(ok, F.regexp_replace(F.regexp_replace(F.trim(text), r"\.", ""), ",", ".").try_cast(MONEY))


def factor(c: Column) -> Column:
    """Positive, or NULL; never 1 by default."""
    return F.when(c > 0, c)


def discount_rate(c: Column) -> Column:
    """A rate from 0 to 1; above 1 up to 100 it was a percentage; else NULL."""
    return F.when(c.between(0, 1), c).when((c > 1) & (c <= 100), c / 100).cast(RATE)


def net(pre: Column, rate: Column) -> Column:
    return (pre * (F.lit(1) - rate)).cast(MONEY)


def order_price(unit: Column, pieces: Column) -> Column:
    return (unit * pieces).cast(MONEY)


def suggested_quantity(c: Column) -> Column:
    """Whole cartons, half to even; negatives are none."""
    n = F.bround(c.cast("double"), 0)
    return F.when(n >= 0, n.cast("int"))


def small_count(c: Column) -> Column:
    """A positive whole number up to 100,000, else NULL."""
    return F.when((c == F.floor(c)) & (c > 0) & (c <= 100_000), c.cast("int"))


def gtin_valid(code: Column) -> Column:
    """The check digit of GTIN-8, 12, 13 and 14: weights 3 and 1 from the right."""
    ok = code.rlike(r"^\d+$") & F.length(code).isin(8, 12, 13, 14)
    figures = F.reverse(F.split(F.when(ok, code), ""))
    total = F.aggregate(F.transform(figures, lambda d, i: d.cast("int") * F.when(i % 2 == 1, 3).otherwise(1)), F.lit(0), lambda a, x: a + x)
    return ok & F.coalesce(total % 10 == 0, F.lit(False))


def money_matches(a: Column, b: Column) -> Column:
    """Within two cents or a thousandth."""
    return F.abs(a - b) <= F.greatest(F.lit("0.02").cast(MONEY), (F.abs(a) * F.lit("0.001").cast(MONEY)).cast(MONEY))


def declared_quantity(text: Column) -> Column:
    """The n of `X n` if the text has exactly one."""
    found = F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"X\s*(\d{1,5})"), F.lit(1)))
    return F.when(F.size(found) == 1, found[0].cast("int"))


def in_threshold_unit(quantity: Column, pieces_per_carton: Column, unit: Column) -> Column:
    """Cartons as cartons or as pieces; NULL where the factor is missing or the unit unknown."""
    return F.when(unit == "CARTONS", quantity.cast(MONEY)).when((unit == "PIECES") & (pieces_per_carton > 0), (quantity * pieces_per_carton).cast(MONEY))
