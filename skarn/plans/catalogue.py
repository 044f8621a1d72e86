"""Every named query of the engine, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from skarn.plans import (  # noqa: F401  they register
    documents_queries,
    linkage_queries,
    markup_queries,
    migration_queries,
    more_queries,
    relational_queries,
)
from skarn.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
