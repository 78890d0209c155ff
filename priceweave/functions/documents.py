"""JSON of any form, as VARIANT: one canonical text for a value, and lists from scalars, arrays or objects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(json: Column) -> Column:
    """The text of a JSON value that does not depend on white space, the order of keys or how its numbers are written;
    NULL where the text is no JSON."""
    return F.to_json(F.try_parse_json(json))


def json_fingerprint(json: Column, size: int = 64) -> Column:
    """The first digits of the SHA-256 of the canonical text."""
    return F.substring(F.sha2(canonical(json), 256), 1, size)


def listed(json: Column, path: str = "$") -> Column:
    """array<string> of what stands at a path: the elements of an array without NULLs, a scalar alone, the values of an
    object by the order of its keys; NULL, an absent path and what is no JSON are empty."""
    value = F.try_parse_json(json)
    get = lambda kind: F.try_variant_get(value, path, kind)
    of_array = F.filter(get("array<string>"), lambda x: x.isNotNull())
    entries = F.array_sort(F.map_entries(get("map<string,string>")))
    of_object = F.filter(F.transform(entries, lambda e: e["value"]), lambda x: x.isNotNull())
    scalar = get("string")
    return F.coalesce(of_array, of_object, F.when(scalar.isNotNull(), F.array(scalar)), F.array().cast("array<string>"))


def eligible(json: Column, group: Column | None = None) -> Column:
    """struct<products, eans, source_rows, group, mix_allowed> of what a promotion is for.

    An object says it by these fields, each an array or a scalar; an array or a scalar, or a text that is no JSON, names
    products. Empty texts and NULLs are none. Where no group is named the one given holds."""
    value = F.try_parse_json(json)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))
    none, default = F.array().cast("array<string>"), F.lit(None).cast("string") if group is None else group
    some = lambda c: F.filter(c, lambda x: x != "")
    field = lambda name: F.when(is_object, some(listed(json, f"$.{name}"))).otherwise(none)
    plain = F.when(value.isNull() & (F.trim(json) != ""), F.array(json)).otherwise(some(listed(json)))
    named = F.try_variant_get(value, "$.group", "string")
    return F.struct(
        F.when(is_object, field("products")).otherwise(F.coalesce(plain, none)).alias("products"),
        field("eans").alias("eans"),
        F.filter(F.transform(field("source_rows"), lambda x: x.try_cast("int")), lambda x: x.isNotNull()).alias("source_rows"),
        F.coalesce(F.when(is_object & (named != ""), named), default).alias("group"),
        F.when(is_object, F.try_variant_get(value, "$.mix_allowed", "boolean")).alias("mix_allowed"),
    )
