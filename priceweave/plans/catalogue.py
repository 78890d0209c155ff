"""All queries of the engine."""

from __future__ import annotations

from . import queries_conditions, queries_documents, queries_intake, queries_judge, queries_ledger, queries_matching, queries_review, queries_sources, queries_state, queries_versions, queries_wording  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
