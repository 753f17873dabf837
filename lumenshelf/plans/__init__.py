"""Registered queries of the recommendation operators and their SQL."""

from __future__ import annotations

from . import activity_queries, bridge_queries, catalogue_queries, curation_queries, parsing_queries, taste_queries, text_queries, upkeep_queries, vector_queries
from .vector_queries import flagship as flagship

_PARTS = [text_queries, vector_queries, activity_queries, taste_queries, catalogue_queries, curation_queries, bridge_queries, parsing_queries, upkeep_queries]


def queries() -> dict:
    return {name: q for part in _PARTS for name, q in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.oracle_sql().items()}
