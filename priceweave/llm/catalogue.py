"""All queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, clustering, decontaminate, extract, jaccard, lexical, line_dedup, packing, pii, quality, suffix_dedup, topk, toxicity

MODULES = (decontaminate, suffix_dedup, jaccard, quality, extract, topk, chat_format, pii, line_dedup, packing, clustering, toxicity, lexical)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
