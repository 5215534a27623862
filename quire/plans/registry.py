"""All registered queries of the engine."""

from __future__ import annotations

from quire.plans import chunk_queries, evaluation_queries, page_queries, reduction_queries, source_queries, structure_queries, text_queries
from quire.plans.base import Query

MODULES = (text_queries, chunk_queries, evaluation_queries, reduction_queries, structure_queries, page_queries, source_queries)


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.R.sql.items()}
