"""All queries of the core with the SQL that checks them."""

from __future__ import annotations

from rosterlake.plans import pool, privacy, records, relational, retrieval

MODULES = (retrieval, pool, privacy, relational, records)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
