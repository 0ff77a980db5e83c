"""Access by integer key over Parquet sorted by that key.

Row groups carry the least and greatest key, so point and range lookups read only the row
groups that can hold a match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row a key: that with the highest seq (the last write wins), and of equal ones that with the greatest values."""
    others = [seq, *(c for c in rows.columns if c not in (key, seq))]
    return rows.groupBy(key).agg(F.max(F.struct(*others)).alias("row")).select(key, *[F.col(f"row.{c}").alias(c) for c in rows.columns if c != key])


class KeyIndex:
    """A unique index in a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder, key

    @classmethod
    def build(cls, rows: DataFrame, key: str, folder: str, seq: str | None = None, mode: str = "errorifexists") -> KeyIndex:
        """Write rows sorted by key; of equal keys the one with the highest ``seq`` stays."""
        kept = latest(rows, key, seq) if seq else rows.dropDuplicates([key])
        n = max(1, rows.sparkSession.sparkContext.defaultParallelism)
        kept.repartitionByRange(n, key).sortWithinPartitions(key).write.mode(mode).parquet(folder)
        return cls(rows.sparkSession, folder, key)

    def rows(self) -> DataFrame:
        """All entries."""
        return self.spark.read.parquet(self.folder)

    def lookup(self, key: int) -> DataFrame:
        """The entry of a key, or no row."""
        return self.rows().where(F.col(self.key) == key)

    def range(self, low: int, high: int) -> DataFrame:
        """Entries from low to high, both included, in key order."""
        return self.rows().where(F.col(self.key).between(low, high)).orderBy(self.key)

    def is_empty(self) -> bool:
        """Whether there is no entry."""
        return self.rows().isEmpty()
