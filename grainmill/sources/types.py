"""INT and VARCHAR(n) as Spark types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

MOST_VARCHAR = 65535


@dataclass(frozen=True)
class ColumnDef:
    """A declared column; ``length`` is None for INT, bytes for VARCHAR."""

    name: str
    length: int | None = None

    def __post_init__(self) -> None:
        if self.length is not None and not 1 <= self.length <= MOST_VARCHAR:
            raise ValueError(f"VARCHAR({self.length}) of column {self.name}: the length is 1 to {MOST_VARCHAR}")

    def field(self) -> T.StructField:
        """The Spark field; the declared length is kept as metadata."""
        if self.length is None:
            return T.StructField(self.name, T.IntegerType(), False)
        return T.StructField(self.name, T.StringType(), False, {"bytes": self.length})


def struct(columns: list[ColumnDef]) -> T.StructType:
    """Schema of declared columns; names must differ."""
    names = [c.name for c in columns]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"COLUMN_ALREADY_EXISTS: {', '.join(sorted(twice))}")
    return T.StructType([c.field() for c in columns])
