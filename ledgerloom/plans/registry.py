"""All queries of the library, with DuckDB SQL for each."""

from __future__ import annotations

from . import event_queries, governance_queries, index_queries, source_queries, turn_queries  # noqa: F401  (importing registers the queries)
from .catalog import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
