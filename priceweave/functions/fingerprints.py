"""Fingerprints: SHA-256 over fields joined by a mark, so that no field's end is another's start."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import name_text

_MARK = "\x1f"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def digest(*columns: Column, size: int = 64, mark: str = _MARK) -> Column:
    return F.substring(F.sha2(F.concat_ws(mark, *[_text(c) for c in columns]), 256), 1, size)


def article(supplier: Column, ean: Column, code: Column, name: Column) -> Column:
    """What a supplier's article is, whatever it costs."""
    return F.concat_ws("|", _text(supplier), _text(ean), _text(code), _text(name_text(name)))


def product(ean: Column, name: Column) -> Column:
    joined = F.concat_ws("|", _text(ean), _text(name_text(name)))
    return F.when(joined == "|", "").otherwise(joined)


def identifies(fingerprint: Column) -> Column:
    return F.regexp_replace(fingerprint, r"\|", "") != ""


def case(row: Column, supplier: Column, description: Column, candidates: Column) -> Column:
    """Of a question and its ordered candidates (array of texts): tells an answer to another question."""
    return digest(row, supplier, description, F.array_join(candidates, "\x1e"), size=16)


def composition(pairs: Column) -> Column:
    """Of array<struct<identifier, quantity>>, in any order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat_ws(":", p["identifier"].cast("string"), p["quantity"].cast("string"))), _MARK), 256)
