"""Every operator bound to the given tables, with the same result as SQL where SQL can say it."""

from labelloom.queries.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
