"""Every registered query of the library and its DuckDB twin."""

from __future__ import annotations

from . import log_queries, more_queries  # noqa: F401
from . import queries as q


def queries() -> dict:
    return dict(q.QUERIES)


def oracle_sql() -> dict:
    return dict(q.SQL)
