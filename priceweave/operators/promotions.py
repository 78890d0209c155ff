"""Promotions: what texts and discounts promise, and what an order earns of it.

A promotional text is cut into pieces once: numbers, words, signs, spaces. Each piece has a kind of one letter, so the text
has a line of kinds as long as its list of pieces. What the text promises is read off that line, and the pieces at the same
places give the numbers and names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import UNITS
from ..functions.text import plain_text

# fixed values: the words of promotional texts; a verb is often misspelt
VERBS = "ACQUISTANDO|ACQUISTANO|ACQUISTATI|ACQUISTA|ACQUSITANDO|ACQUSITA|COMPRANDO|COMPRA|OGNI"
GIVEN = "IN OMAGGIO|RICEVI"
MARKS = "OFFERTA|PROMOZIONE|PROMO|SCONTO"
# fixed values: measures, whose sums are contents and not pieces
MEASURES = "ML|CL|LT|L|GR|G|KG|MT|M|CM|MM|LAVAGGI|LAV|W"

PIECES = r"([0-9]+(?:[.,][0-9]+)?|[^\W0-9]+|\s+|[^\w\s])"
#: Kinds of words: verb, at least, in, gift, get, free, other marks, of; units of orders, measures, what is both.
_WORDS = {
    **dict.fromkeys(VERBS.split("|"), "v"),
    **dict.fromkeys(MARKS.split("|"), "k"),
    **{"ALMENO": "a", "IN": "i", "OMAGGIO": "o", "RICEVI": "r", "GRATIS": "g", "DI": "d"},
    **dict.fromkeys(UNITS, "u"),
    **dict.fromkeys(MEASURES.split("|"), "m"),
    **dict.fromkeys(set(UNITS) & set(MEASURES.split("|")), "c"),
}
#: Kinds of signs that say something; a small number is n, any other N, a space _, a word w, a sign s.
_SIGNS = {"+": "p", "=": "e", ":": ":", "(": "(", ")": ")", ".": ".", ",": ","}
_WORD_KIND, _NUMBER_KIND = "[vkaiorgdumcw]", "[nN]"
_ORDER_UNIT = f"[uc](?!{_NUMBER_KIND})"
_MEASURE = f"[mc](?!{_NUMBER_KIND})"
_BEGIN = f"(?<!{_NUMBER_KIND})"
#: For so many units something is given.
_THRESHOLD = (f"{_BEGIN}v_(?:a_)?", f"{_NUMBER_KIND}_?{_ORDER_UNIT}")
#: So many units are given, of what stands behind.
_REWARD = (f"{_BEGIN}(?:(?:r_)?i_o|r)_?:?_?", f"{_NUMBER_KIND}(?:_?{_ORDER_UNIT}|(?!{_WORD_KIND}))")
_GIVEN_OF = r"_?(?:\([^)]*\)_?)?(?:o_?)?(?:d_)?"
#: Pieces and more pieces in a pack; no measure before or behind makes them a content, and something says they are free.
_INCLUDED = (rf"(?<![.,])(?<!{_BEGIN}[mc]_?\.?_?)", f"n_?p_?n(?!_?(?:(?:i_)?o|g)?_?(?:e_?{_NUMBER_KIND})?_?{_MEASURE})(?=.*{_BEGIN}[og](?!{_NUMBER_KIND}))")
_MARKED = f"{_BEGIN}[orgkv](?!{_NUMBER_KIND})"


def _kind(piece: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in {**_WORDS, **_SIGNS}.items() for x in pair])
    other = F.when(piece.rlike("^[0-9]{1,4}$"), "n").when(piece.rlike("^[0-9]"), "N").when(piece.rlike(r"^\s"), "_").when(piece.rlike(r"^\w"), "w").otherwise("s")
    return F.coalesce(F.try_element_at(names, piece), other)


def _unit(word: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    return F.try_element_at(names, word)


def _place(kinds: Column, before: str, what: str) -> Column:
    """How many pieces stand before the first place where the two patterns meet; NULL if they never do."""
    pattern = f"^(.*?{before}){what}"
    return F.when(kinds.rlike(pattern), F.length(F.regexp_extract(kinds, pattern, 1)))


def _counted(pieces: Column, kinds: Column, place: Column) -> tuple[Column, Column]:
    """(number, unit) at a place: the unit may follow at once or behind a space."""
    gap = F.when(F.substring(kinds, place + 2, F.lit(1)) == "_", 2).otherwise(1)
    at = place + gap
    unit = F.when(F.substring(kinds, at + 1, F.lit(2)).rlike(f"^{_ORDER_UNIT}"), _unit(F.get(pieces, at)))
    return F.get(pieces, place).try_cast("int"), unit


def parse_text(text: Column) -> Column:
    """struct<kind, threshold, threshold_unit, reward, reward_unit, reward_text, certain> of a promotional text; NULL if
    nothing marks one. The first kind that fits counts: THRESHOLD_GIFT, INCLUDED_PACK, REVIEW."""
    pieces = F.regexp_extract_all(plain_text(text), F.lit("(?U)" + PIECES))
    kinds = F.array_join(F.transform(pieces, _kind), "")
    n, unit = _counted(pieces, kinds, _place(kinds, *_THRESHOLD))
    m, reward_unit = _counted(pieces, kinds, _place(kinds, *_REWARD))
    of = _place(kinds, "".join(_REWARD) + _GIVEN_OF, "(?=.)")
    what = F.trim(F.array_join(F.slice(pieces, of + 1, F.size(pieces)), ""))
    what = F.when(what != "", what)
    pair = _place(kinds, *_INCLUDED)
    numbers = F.filter(F.slice(pieces, pair + 1, 5), lambda x: x.rlike("^[0-9]"))
    a, b = F.get(numbers, F.lit(0)).try_cast("int"), F.get(numbers, F.lit(1)).try_cast("int")
    none = F.lit(None)

    def made(kind, n, unit, m, reward_unit, what, certain):
        return F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("threshold"), unit.cast("string").alias("threshold_unit"), m.cast("int").alias("reward"), reward_unit.cast("string").alias("reward_unit"), what.cast("string").alias("reward_text"), certain.alias("certain"))

    gift = made("THRESHOLD_GIFT", n, unit, m, reward_unit, what, what.isNotNull())
    pack = made("INCLUDED_PACK", a, none, b, none, none, F.lit(True))
    review = made("REVIEW", none, none, none, none, none, F.lit(False))
    one_more = F.array_join(pieces, "").rlike(r"\b1\s*\+\s*1\b")
    return F.when((n > 0) & (m > 0), gift).when((a > 0) & (b > 0), pack).when(kinds.rlike(_MARKED) | one_more, review)


def numeric_discount(rate: Column) -> Column:
    """A rate in (0, 1); from 1 on it was a percentage; else NULL."""
    r = F.when((rate > 0) & (rate < 1), rate).when((rate >= 1) & (rate < 100), rate / 100)
    return r.cast("decimal(9,4)")


def eligible_pairs(products: DataFrame, promotions: DataFrame) -> DataFrame:
    """promotion_id, product_id where the id, the code or a group agrees: three equi-joins and their union, no
    nested loop over the disjunction.

    products: product_id, ean, group_id. promotions: promotion_id, product_id, ean, group_id (any may be NULL)."""
    out = None
    for key in ("product_id", "ean", "group_id"):
        wanted = promotions.where(F.col(key).isNotNull()).select("promotion_id", F.col(key).alias("__key"))
        own = products.select(F.col("product_id").alias("__product"), F.col(key).alias("__key2"))
        pairs = wanted.join(own, F.col("__key") == F.col("__key2")).select("promotion_id", F.col("__product").alias("product_id"))
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def progress(promotions: DataFrame, lines: DataFrame, near: float = 0.8) -> DataFrame:
    """State of each threshold promotion over the order lines of its supplier: progress, remaining, status, rewards.

    promotions: promotion_id, supplier, threshold, unit, repeatable, group_id. lines: supplier, group_id, cartons, pieces."""
    summed = lines.groupBy("supplier", "group_id").agg(F.sum("cartons").alias("cartons"), F.sum("pieces").alias("pieces"))
    j = promotions.join(summed, ["supplier", "group_id"], "left")
    done = F.coalesce(F.when(F.col("unit") == "CARTONS", F.col("cartons")).otherwise(F.col("pieces")), F.lit(0)).cast("decimal(18,4)")
    left = F.greatest(F.col("threshold") - done, F.lit(0)).cast("decimal(18,4)")
    status = F.when(done >= F.col("threshold"), "EARNED").when((done > 0) & ((done >= F.col("threshold") * F.lit(near).cast("decimal(9,4)")) | (left <= 1)), "NEAR").otherwise("NOT_REACHED")
    times = F.when(done >= F.col("threshold"), F.when(F.col("repeatable"), F.floor(done / F.col("threshold"))).otherwise(1)).otherwise(0)
    return j.select("promotion_id", "supplier", done.alias("progress"), left.alias("remaining"), status.alias("status"), times.cast("long").alias("rewards"))


def summary(states: DataFrame) -> DataFrame:
    """Promotions by supplier and status, as columns."""
    names = ["EARNED", "NEAR", "NOT_REACHED"]
    return states.groupBy("supplier").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in names])


def by_text(offers: DataFrame) -> DataFrame:
    """Offers of a supplier with the same normalised promotional text: products, first and last row, mixed or single."""
    return offers.groupBy("supplier", plain_text(F.col("promo_text")).alias("promo")).agg(F.countDistinct("ean").alias("n_products"), F.min("source_row").alias("first_row"), F.max("source_row").alias("last_row"), (F.count("*") > 1).alias("mixed"))


def effective_price(base: Column, rate: Column, confirmed: Column, active: Column, applied: Column) -> Column:
    """The base lowered by a confirmed, active rate that is not in it yet."""
    ok = confirmed & active & ~applied & (rate > 0) & (rate < 1)
    return F.when(ok, (base * (F.lit(1) - rate)).cast("decimal(18,6)")).otherwise(base.cast("decimal(18,6)"))
