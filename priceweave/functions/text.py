"""Text columns: the several normalised forms that matching, search and fingerprints use. All are native expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that stand for each other, and words that tell nothing
ALIASES = {"DEODORANTE": "DEO", "CANDEG": "CANDEGGINA", "CANDEGG": "CANDEGGINA", "RIC": "RICARICA", "RICAR": "RICARICA", "PZ": "PEZZI", "PZZ": "PEZZI", "LT": "L", "LITRO": "L", "LITRI": "L", "GR": "G", "GRAMMI": "G"}
STOP_WORDS = ("A", "AL", "ALLA", "CON", "DA", "DAL", "DE", "DEL", "DELLA", "DI", "E", "IL", "IN", "LA", "LE", "LO", "NEW", "PER", "PIU", "THE", "UN", "UNA")

PROMOTION_WORD = "PROMO|OFFERTA|OMAGGIO|SCONTO|GRATIS"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def ean(c: Column) -> Column:
    """Trimmed; a whole number's trailing .0 goes; leading zeros and odd codes stay."""
    return F.regexp_replace(F.trim(c), r"^(\d+)\.0+$", "$1")


def digits(c: Column) -> Column:
    return F.regexp_replace(ean(c), r"[^0-9]", "")


def valid_ean_shape(c: Column) -> Column:
    return c.rlike(r"^[0-9]+$") & F.length(c).isin(8, 12, 13, 14) & c.rlike("[1-9]")


@cache
def _decompositions() -> tuple[str, str, dict[str, str]]:
    """By Unicode's own tables: characters of the basic plane whose compatibility decomposition without marks is one
    other character, those characters, and longer decompositions that hold a letter, digit, point or comma of ASCII."""
    one, to, many = [], [], {}
    for code in (*range(0xA0, 0xAC00), *range(0xF900, 0xFFFE)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.upper()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c.upper():
            one.append(c)
            to.append(plain)
        elif len(plain) > 1 and plain != c.upper() and any(x.isascii() and x.isalnum() or x in ".," for x in plain):
            many[c] = plain
    return "".join(one), "".join(to), many


def fold(c: Column) -> Column:
    """Upper case, decomposed (NFKD), without marks; texts of ASCII characters skip the tables."""
    one, to, many = _decompositions()
    longer = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    letters = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(longer, x), x)), "")
    whole = F.when(c.rlike(f"[{re.escape(''.join(many))}]"), letters).otherwise(c)
    plain = F.upper(F.regexp_replace(F.translate(whole, one, to), r"\p{Mn}", ""))
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(F.upper(c))


def _squeezed(c: Column, other: str) -> Column:
    return F.trim(F.regexp_replace(c, other, " "))


def matching_text(c: Column, plus: bool = False) -> Column:
    """Letters, digits, points and commas, for comparing descriptions."""
    return _squeezed(fold(c), r"[^A-Z0-9.,+]+" if plus else r"[^A-Z0-9.,]+")


def name_text(c: Column) -> Column:
    """Letters and digits only, for identities."""
    return _squeezed(fold(c), r"[^A-Z0-9]+")


def plain_text(c: Column) -> Column:
    return _squeezed(fold(c), r"\s+")


def search_text(c: Column) -> Column:
    return F.lower(name_text(c))


def header_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold(c)), r"[^a-z0-9]+", "")


def tokens(c: Column) -> Column:
    """Distinct words of the matching text of two characters or more, aliases unified, without stop words."""
    words = F.split(matching_text(c), " ")
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    unified = F.transform(words, lambda w: F.coalesce(F.try_element_at(alias, w), w))
    return F.array_distinct(F.filter(unified, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)))


def shortened(c: Column, limit: int = 180) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 1), F.lit("…"))).otherwise(c)


def contains_all_words(text: Column, query: Column) -> Column:
    """Every word of a query of two characters or more stands in the text."""
    return (F.length(query) >= 2) & F.forall(F.split(query, " "), lambda w: F.contains(text, w))


def column_letters(n: Column) -> Column:
    """A, B, ... Z, AA, ... of a column number from 1 to 18,278."""
    a = (n - 1).cast("int")
    letter = lambda k: F.chr(F.lit(65) + k)
    one = letter(a % 26)
    b = (F.floor(a / 26) - 1).cast("int")
    two = F.concat(letter(b % 26), one)
    third = (F.floor(b / 26) - 1).cast("int")
    return F.when(a < 26, one).when(b < 26, two).otherwise(F.concat(letter(third), two))


def natural_order(c: Column) -> Column:
    """A key that orders by letters without case or marks, numbers by value."""
    parts = F.regexp_extract_all(name_text(c), F.lit(r"(\d+|\D+)"))
    # a number of more digits is greater, so their count comes first
    value = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(value(x)).cast("string"), 4, "0"), value(x))).otherwise(x)), "")
