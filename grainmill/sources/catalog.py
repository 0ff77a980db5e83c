"""Tables of a session: created, appended to, looked up, loaded."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.semantics import fit_bytes
from grainmill.sources.types import ColumnDef, struct


class Catalog:
    """Managed Parquet tables in Spark's catalog; VARCHAR lengths stay in the fields' metadata."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def create_table(self, name: str, columns: list[ColumnDef]) -> None:
        """Declare a table; an existing name is an error."""
        schema = struct(columns)
        if self.exists(name):
            raise ValueError(f"TABLE_OR_VIEW_ALREADY_EXISTS: {name}")
        self.spark.catalog.createTable(name, source="parquet", schema=T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema]))

    def exists(self, name: str) -> bool:
        """Whether a table or view has that name."""
        return self.spark.catalog.tableExists(name)

    def table(self, name: str) -> DataFrame:
        """A table's rows; an unknown name is an error of Spark's analyser."""
        return self.spark.table(name)

    def insert(self, name: str, rows: Iterable[tuple]) -> int:
        """Append rows given by position, as one write; texts are cut to the declared bytes."""
        schema = self.table(name).schema
        rows = [tuple(r) for r in rows]
        for row in rows:
            if len(row) != len(schema):
                raise ValueError(f"{name} has {len(schema)} columns, the row {len(row)} values")
            for value, field in zip(row, schema, strict=True):
                wanted = int if isinstance(field.dataType, T.IntegerType) else str
                if type(value) is not wanted:
                    raise TypeError(f"column {field.name} takes {wanted.__name__}, not {value!r}")
                if wanted is int and not -(2**31) <= value < 2**31:
                    raise ValueError(f"column {field.name}: {value} is not a 32-bit integer")
        self.append(name, self.spark.createDataFrame(rows, schema))
        return len(rows)

    def append(self, name: str, rows: DataFrame) -> None:
        """Append a DataFrame whose columns stand in the table's order."""
        schema = self.table(name).schema
        columns = [
            fit_bytes(F.col(f"`{c}`"), f.metadata["bytes"]).alias(f.name) if "bytes" in f.metadata else F.col(f"`{c}`").cast(f.dataType).alias(f.name)
            for c, f in zip(rows.columns, schema, strict=True)
        ]
        rows.select(*columns).write.mode("append").insertInto(name)

    def load_folder(self, folder: str, names: Iterable[str]) -> None:
        """Views over Parquet files ``folder/name.parquet``."""
        for name in names:
            self.spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
