"""One statement of SQL to one result."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from grainmill.plans import compat as small
from grainmill.plans import explain
from grainmill.plans.grammar import Create, Explain, Insert, SqlError, parse
from grainmill.sources.catalog import Catalog


@dataclass
class Result:
    """Column names and a DataFrame, or a message."""

    columns: list[str]
    frame: DataFrame | None = None
    message: str = ""

    def rows(self) -> Iterator[list[str]]:
        """Cells as text, row by row; rows come from the executors as they are read."""
        if self.frame is not None:
            for row in self.frame.toLocalIterator():
                yield ["NULL" if v is None else str(v) for v in row]


class Database:
    """Statements against a session's tables.

    SELECT goes to Spark's own SQL; with ``compat`` it is read by the small grammar and gives the
    compatible results.  CREATE TABLE, INSERT and EXPLAIN are the small grammar's either way.
    """

    def __init__(self, spark: SparkSession, compat: bool = False) -> None:
        self.spark, self.catalog, self.compat = spark, Catalog(spark), compat

    def execute(self, sql: str, compat: bool | None = None) -> Result:
        """Run a statement."""
        compat = self.compat if compat is None else compat
        word = re.match(r"(?:\s+|--[^\n]*(?:\n|\Z))*(\w*)", sql)[1].upper()
        if word == "SELECT" and not compat:
            df = self.spark.sql(sql.strip().rstrip(";"))
            return Result(df.columns, df)
        if word == "EXPLAIN" and not compat:
            df = self.spark.sql(re.sub(r"(?is)^(?:\s+|--[^\n]*\n)*explain", "", sql, count=1).strip().rstrip(";"))
            return self._lines(explain.physical(df))
        made = parse(sql)
        if isinstance(made, Create):
            self.catalog.create_table(made.table, made.columns)
            return Result([], message=f"Table '{made.table}' created.")
        if isinstance(made, Insert):
            n = self.catalog.insert(made.table, made.rows)
            return Result([], message=f"Inserted {n} row{'' if n == 1 else 's'}.")
        if isinstance(made, Explain):
            df = small.planned(self.catalog, made.select)
            return self._lines([*explain.operators(made.select), "", *explain.physical(df)])
        df = small.planned(self.catalog, made)
        return Result(df.columns, df)

    def _lines(self, lines: list[str]) -> Result:
        return Result(["plan"], self.spark.createDataFrame([(line,) for line in lines], "plan string").coalesce(1))


__all__ = ["Database", "Result", "SqlError"]
