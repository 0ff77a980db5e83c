"""Registry of this subpackage's queries: opN_<name> over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of the operators; each has QUERY (name), query(spark, sf_dir), and ORACLE_SQL (or None).
MODULES = ("secrets", "digest", "warc", "langid", "quality", "neighbours", "blocks", "mixing", "simhash", "bpe")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    found = [import_module(f"grainmill.llm.{m}") for m in MODULES]
    return {m.QUERY: m.query for m in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those queries that SQL can express."""
    found = [import_module(f"grainmill.llm.{m}") for m in MODULES]
    return {m.QUERY: m.ORACLE_SQL for m in found if m.ORACLE_SQL}
