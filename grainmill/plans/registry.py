"""Registry of relational queries: name -> (callable, DuckDB oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Decorator: register a query under ``name`` with its oracle SQL."""

    def keep(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if oracle is not None:
            _ORACLES[name] = oracle
        return query

    return keep


def queries() -> dict[str, Query]:
    """All relational queries."""
    import_module("grainmill.plans.suite")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Oracle SQL of those queries that have one."""
    import_module("grainmill.plans.suite")
    return dict(_ORACLES)
