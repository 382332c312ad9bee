"""All queries of the library's own operators and their SQL, by name."""

from __future__ import annotations

from . import corpus_queries, eval_queries, misc_queries, report_queries

_MODULES = (corpus_queries, report_queries, eval_queries, misc_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
