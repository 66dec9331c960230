"""Queries: the operators bound to the supplied tables, each with its SQL check."""

from isopleth.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
