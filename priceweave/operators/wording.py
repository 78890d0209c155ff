"""What people read of an order: quantities with their units, messages of earned thresholds, dates, and lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_text

# fixed values: the words of messages and dates
UNITS = {"ct": "cartoni", "cartone": "cartoni", "cartoni": "cartoni", "collo": "colli", "colli": "colli", "pz": "pezzi", "pezzo": "pezzi", "pezzi": "pezzi", "unità": "unità", "unita": "unità", "espositore": "espositori", "espositori": "espositori"}
SINGULAR = {"cartoni": "cartone", "colli": "collo", "pezzi": "pezzo", "unità": "unità", "espositori": "espositore"}
ORDINALS = ["secondo", "terzo", "quarto", "quinto", "sesto", "settimo", "ottavo", "nono", "decimo"]
MONTHS = ["gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"]


def _of(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def unit_name(unit: Column) -> Column:
    """A unit's plural, however it is written; an unknown one in small letters, an empty one NULL."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(unit, F.lit("")))), r"\.+$", "")
    return F.coalesce(_of(UNITS, plain), F.when(plain != "", plain))


def plain_number(value: Column) -> Column:
    """A number as text: whole ones without decimals, others with six at most and no zeros behind."""
    d = value.cast("decimal(24,6)")
    return F.regexp_replace(d.cast("string"), r"\.?0+$", "")


def with_unit(quantity: Column, unit: Column) -> Column:
    """A quantity with its unit, which is singular for 1 ("1 cartone", "6 cartoni"); the unit alone without a quantity."""
    name = F.coalesce(unit_name(unit), F.lit("unità"))
    agreed = F.when(quantity == 1, F.coalesce(_of(SINGULAR, name), name)).otherwise(name)
    return F.when(quantity.isNull(), name).otherwise(F.concat_ws(" ", plain_number(quantity), agreed))


def gift_text(quantity: Column, unit: Column, description: Column) -> Column:
    """What is given, by name: it need not be what was bought."""
    what = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " "))
    amount = with_unit(F.when((quantity == 0) | quantity.isNull(), F.lit(1)).otherwise(quantity), unit)
    return F.when(what != "", F.concat(amount, F.lit(" di "), what)).otherwise(amount)


def earned_message(threshold: Column, unit: Column, progress: Column, remaining: Column, rewards: Column, gift: Column, repeatable: Column, n_products: Column) -> Column:
    """The rule, what is reached and how far the next gift is. gift: as gift_text. Where several products count together the
    message says so."""
    several = n_products > 1
    among = F.when(several, F.concat(F.lit(" fra i "), n_products.cast("string"), F.lit(" prodotti dell'offerta"))).otherwise("")
    rule = F.concat(with_unit(threshold, unit), among, F.lit(" = "), gift, F.lit(" in omaggio: ne hai "), plain_number(progress), F.when(several, " in tutto").otherwise(""))
    many = F.when(rewards > 1, F.concat(F.lit(", sono "), rewards.cast("string"), F.lit(" omaggi"))).otherwise("")
    ordinal = F.get(F.array(*[F.lit(o) for o in ORDINALS]), rewards.cast("int") - 1)
    following = F.when(ordinal.isNull(), "il prossimo").when(ordinal.rlike("^[aeiou]"), F.concat(F.lit("l'"), ordinal)).otherwise(F.concat(F.lit("il "), ordinal))
    left = F.when(remaining.isNull(), ".").otherwise(F.concat(F.lit(", te ne mancano "), with_unit(remaining, unit), F.lit(" per "), following, F.lit(".")))
    return F.when(~repeatable, F.concat(rule, F.lit(", l'omaggio spetta una volta sola."))).otherwise(F.concat(rule, many, left))


def long_date(moment: Column) -> Column:
    """Day, month by name, year."""
    month = F.get(F.array(*[F.lit(m) for m in MONTHS]), F.month(moment) - 1)
    return F.concat(F.dayofmonth(moment).cast("string"), F.lit(" "), month, F.lit(" "), F.year(moment).cast("string"))


def summary_lines(lines: DataFrame, supplier: str | None = None, by_total: bool = True) -> DataFrame:
    """lines (supplier, name, subtotal) of one supplier, or of all, in order: the greatest subtotals first (none counts 0),
    or by name without case and marks; ties by name."""
    kept = lines if supplier is None else lines.where(F.col("supplier") == supplier)
    name = [name_text(F.col("name")).asc_nulls_first(), F.asc("name")]
    return kept.orderBy(*([F.coalesce("subtotal", F.lit(0)).desc()] if by_total else []), *name)
