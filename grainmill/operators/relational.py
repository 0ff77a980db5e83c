"""Scan, filter, project, join, aggregate, sort over DataFrames with qualified names.

A scan names its columns ``alias.column``; ``resolve`` finds a name among such columns.
Catalyst pushes filters, prunes columns and picks join strategies from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions import semantics
from grainmill.session import shared_folder

#: Rows of either side in a cell of a join with many more pairs than rows; pairs for a row from which a join is such a one.
SIDE, FAN_OUT = 2048, 8
#: Sides below this size are joined uncounted: the pairs are in proportion to the other side.
SMALL_BYTES = 16_384
#: Tasks of such a join at most, and keys of many cells whose list is broadcast.
MOST_TASKS, MOST_HOT = 50_000, 250_000


def scan(df: DataFrame, alias: str) -> DataFrame:
    """The relation under an alias."""
    return df.toDF(*[f"{alias}.{c}" for c in df.columns])


def resolve(df: DataFrame, name: str) -> str:
    """The column that a name means: itself, or the only one with that last part, or, for a
    qualified name after an aggregate, the column of its last part."""
    if df.columns.count(name) == 1:
        return name
    if df.columns.count(name) > 1:
        raise ValueError(f"AMBIGUOUS_REFERENCE: {name}")
    bare = name.rpartition(".")[2]
    found = [c for c in df.columns if c.rpartition(".")[2] == name] if bare == name else [c for c in df.columns if c == bare]
    if len(found) > 1:
        raise ValueError(f"AMBIGUOUS_REFERENCE: {name}")
    if not found:
        raise ValueError(f"UNRESOLVED_COLUMN: {name}")
    return found[0]


def column(df: DataFrame, name: str) -> Column:
    """A column by name."""
    return F.col(f"`{resolve(df, name)}`")


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate holds."""
    return df.where(predicate)


def project(df: DataFrame, items: list[tuple[Column, str]]) -> DataFrame:
    """Expressions under their output names, which may repeat."""
    return df.select(*[c.alias(f"_{i}") for i, (c, _) in enumerate(items)]).toDF(*[name for _, name in items])


def join_on(left: DataFrame, right: DataFrame, left_key: Column | str, right_key: Column | str, hint: str | None = None) -> DataFrame:
    """Inner join on one equality; names or expressions as keys, in either order of sides.

    ``hint`` is one of Spark's strategies (broadcast, merge, shuffle_hash); by default
    Catalyst and AQE choose by size.  They know nothing of the pairs, so without a hint the pairs of two scans joined by
    names are counted first, in a job of its own over the keys; where they are many more than the rows, they are dealt
    over tasks (``_dealt``).
    """
    taken = [c for c in right.columns if c in left.columns]
    if taken:
        raise ValueError(f"AMBIGUOUS_REFERENCE: {', '.join(taken)} on both sides; give the sides aliases")

    def side(key: Column | str) -> tuple[Column, DataFrame | None]:
        if not isinstance(key, str):
            return key, None
        for df in (left, right):
            try:
                return column(df, key), df
            except ValueError as e:
                if "AMBIGUOUS" in str(e):
                    raise
        raise ValueError(f"UNRESOLVED_COLUMN: {key}")

    (a, a_of), (b, b_of) = side(left_key), side(right_key)
    both = left.join(right, F.lit(False)).select(a.alias("a"), b.alias("b")).schema  # analysed only
    a, b = semantics.alike(a, both["a"].dataType, b, both["b"].dataType)
    if hint is None and a_of is not None and b_of is not None and a_of is not b_of:
        keys = (a, b) if a_of is left else (b, a)
        same = left.join(right, F.lit(False)).select(a.alias("a"), b.alias("b")).schema
        if same["a"].dataType == same["b"].dataType and isinstance(same["a"].dataType, T.AtomicType) and all(_scanned(df) and _bytes(df) >= SMALL_BYTES for df in (left, right)):
            dealt = _dealt(left, right, *keys)
            if dealt is not None:
                return dealt
    return left.join(right.hint(hint) if hint else right, a == b, "inner")


def _scanned(df: DataFrame) -> bool:
    """Whether the rows are those of a table, projected and filtered: counting them costs a scan, not another join."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.deterministic() and plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.deterministic() and plan.children().isEmpty() and plan.getClass().getSimpleName() in ("LogicalRelation", "LocalRelation")


def _bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _dealt(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame | None:
    """The inner join with its pairs dealt over tasks, or None where they are few for the rows.

    A key's pairs are cut into cells of about SIDE rows of either side (by hash: rows equal in every column stay together);
    each row goes to all cells of its stripe, so SIDE pairs or more are made of each row that is shuffled, and no task
    holds more than its cells.  The number of tasks follows the number of pairs, which AQE does not see.
    """
    counts = (
        left.groupBy(left_key.alias("__key")).agg(F.count(F.lit(1)).alias("__left"))
        .join(right.groupBy(right_key.alias("__key")).agg(F.count(F.lit(1)).alias("__right")), "__key")
    )
    of_key = F.col("__left").cast("double") * F.col("__right")
    pairs, lefts, rights, hot = counts.agg(F.sum(of_key), F.sum("__left"), F.sum("__right"), F.count_if(of_key > SIDE * SIDE)).first()
    if not pairs or pairs < max(SIDE * SIDE, FAN_OUT * (lefts + rights)):
        return None
    tasks = min(MOST_TASKS, max(4 * left.sparkSession.sparkContext.defaultParallelism, int(-(-pairs // (SIDE * SIDE)))))
    cuts = counts.where(of_key > SIDE * SIDE).select("__key", *[F.ceil(F.col(c) / SIDE).cast("int").alias(f"{c}_cuts") for c in ("__left", "__right")])
    cuts = F.broadcast(cuts) if hot <= MOST_HOT else cuts

    def cells(df: DataFrame, key: Column, own: str, other: str) -> DataFrame:
        """The rows with their key and cell: the own stripe by hash, every stripe of the other side."""
        rows = df.where(key.isNotNull()).withColumn("__key", key)
        rows = rows.join(cuts, "__key", "left") if hot else rows.withColumns({"__left_cuts": F.lit(1), "__right_cuts": F.lit(1)})
        n, m = (F.coalesce(f"{c}_cuts", F.lit(1)) for c in (own, other))
        hashed = F.xxhash64(*[f"`{f.name}`" for f in df.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)])
        at = {own: F.pmod(hashed, n).cast("int"), other: F.explode(F.sequence(F.lit(0), m - 1))}
        rows = rows.select(*[f"`{c}`" for c in df.columns], F.col("__key").alias(f"{own}_key"), *[c.alias(f"{own}_of{k}") for k, c in at.items()])
        return rows.repartition(tasks, f"{own}_key", f"{own}_of__left", f"{own}_of__right")

    a, b = cells(left, left_key, "__left", "__right"), cells(right, right_key, "__right", "__left")
    met = [F.col(f"__left_{c}") == F.col(f"__right_{c}") for c in ("key", "of__left", "of__right")]
    a, b = (a, b) if lefts >= rights else (b, a)  # the merge holds a cell's rows of the second, which are fewer
    return a.join(b.hint("merge"), met, "inner").select(*[f"`{c}`" for c in (*left.columns, *right.columns)])


@dataclass(frozen=True)
class Aggregate:
    """One aggregate: COUNT, SUM, AVG, MIN or MAX of a column, under a name."""

    function: str
    argument: Column | None
    name: str

    def standard(self) -> Column:
        """With Spark's results."""
        make: dict[str, Callable[[Column], Column]] = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
        if self.argument is None:
            if self.function != "COUNT":
                raise ValueError(f"{self.function}(*) has no meaning")
            return F.count(F.lit(1))
        return make[self.function](self.argument)

    def compatible(self) -> Column:
        """With 32-bit sums and truncated averages; COUNT counts rows."""
        if self.function == "COUNT":
            return F.count(F.lit(1))
        if self.function == "SUM" and self.argument is not None:
            return semantics.wrapping_sum(self.argument)
        if self.function == "AVG" and self.argument is not None:
            return semantics.int_avg(self.argument)
        return self.standard()


def aggregate(df: DataFrame, keys: list[str], aggregates: list[Aggregate], compat: bool = False, empty: str = "none") -> DataFrame:
    """Groups by keys (bare names in the result), then aggregates; without aggregates, the distinct keys."""
    made = [(a.compatible() if compat else a.standard()).alias(f"a{i}") for i, a in enumerate(aggregates)]
    names = [k.rpartition(".")[2] for k in keys] + [a.name for a in aggregates]
    own = [column(df, k).alias(f"k{i}") for i, k in enumerate(keys)]
    if not keys:
        return semantics.global_agg(df, *made, empty=empty).toDF(*names)
    if not made:
        return df.select(*own).distinct().toDF(*names)
    return df.groupBy(*own).agg(*made).toDF(*names)


def order_by(df: DataFrame, keys: list[tuple[Column | str, bool]]) -> DataFrame:
    """Sort by (key, ascending); a global sort by ranges of the first keys."""
    columns = [column(df, k) if isinstance(k, str) else k for k, _ in keys]
    return df.orderBy(*[c.asc() if up else c.desc() for c, (_, up) in zip(columns, keys, strict=True)])


def placed(df: DataFrame, keys: list[tuple[Column | str, bool]], name: str = "place") -> DataFrame:
    """The sorted rows with their places, from 1 on, counted after the sort: rows are written in sorted order with their
    place in their range, and the ranges' sizes (one row each) give the rest."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/grainmill/sorted-{uuid.uuid4().hex}"
    order_by(df, keys).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.col("_before") + F.col("_at") - F.shiftleft("_range", 33) + 1
    return rows.join(ranges, "_range").select(*[f"`{c}`" for c in df.columns], own.alias(name))


def multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """All values of each key, in order: (key, values)."""
    return df.groupBy(F.col(key)).agg(F.sort_array(F.collect_list(value)).alias("values"))
