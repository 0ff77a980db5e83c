"""What the operators share: shipping code, the shared folder, range cuts, Arrow plumbing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.session import shared_folder

ROOT = str(Path(__file__).resolve().parents[2])

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package (on a cluster it is shipped with --py-files)."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if ROOT not in path.split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{path}" if path else ROOT


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/grainmill/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it: lineage ends, each row is computed once,
    and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def map_rows(
    df: DataFrame, work: Callable[[Iterator[dict]], Iterable[tuple]] | Callable, schema: str, chunk: int = 256
) -> DataFrame:
    """mapInArrow over plain Python rows: work gets an iterator of row tuples of a partition
    and yields tuples of ``schema``; output leaves in batches of at most ``chunk`` rows."""
    prepare(df.sparkSession)
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):  # few Python strings at a time
                    part = batch.slice(at, 64)
                    yield from zip(*(column.to_pylist() for column in part.columns), strict=True)

        held: list[tuple] = []
        for row in work(rows()):
            held.append(row)
            if len(held) == chunk:
                yield packed(held, arrow)
                held = []
        if held:
            yield packed(held, arrow)

    return df.mapInArrow(run, target)


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of row tuples."""
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)],
        schema=schema,
    )


#: Rows of a key, as a part of all, from which they are spread over tasks, and the fewest such rows.
HOT_SHARE, HOT_LEAST = 1 / 4096, 64


def spread_join(many: DataFrame, one: DataFrame, key: str, rows: int, how: str = "inner", by: str | None = None) -> DataFrame:
    """Join of many rows of a key with its one row.  Keys of more than a 4096th of ``rows`` (the number of rows of
    ``many``) are spread by salts: at most 4096 of them, so that list goes through the driver and is broadcast."""
    bar = max(HOT_LEAST, int(rows * HOT_SHARE) + 1)
    counts = many.groupBy(F.col(key).alias("hot_key")).count().where(F.col("count") > bar)
    hot = counts.select("hot_key", F.ceil(F.col("count") / bar).cast("int").alias("salts"))
    found = hot.toArrow()
    if not found.num_rows:
        return many.join(one, key, how)
    hot = F.broadcast(many.sparkSession.createDataFrame(found))  # from Arrow: rows would start Python workers of another kind
    others = [by] if by else [c for c in many.columns if c != key]
    own = many.join(hot, F.col(key) == F.col("hot_key"), "left")
    own = own.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*others), F.col("salts")).cast("int"), F.lit(0))).drop("hot_key", "salts")
    other = one.join(hot, F.col(key) == F.col("hot_key"), "left")
    other = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("hot_key", "salts")
    return own.join(other, [key, "salt"], how).drop("salt")


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """A batch's arrays of equal length, none of them null, as the rows of a matrix."""
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


class Ranges:
    """Parts of the order of (key, tie), both long, of about equal weight and the same in every run.  Rows without
    a key come first.

    Exact weights of equal-width bins decide the cuts: neither sampling nor task order moves them.  A bin that
    outweighs a part is cut into finer bins again and again; one that holds a single key (or no key) is cut by
    ``tie``.  So a part weighs less than twice the goal, unless rows with equal key and tie alone weigh more.  The
    driver gets about ``4 * parts`` rows a level (``bins`` at least).  Beyond ``most`` parts they grow in weight.
    """

    def __init__(self, df: DataFrame, key: str, tie: str, weight: str, part_weight: float, least: int = 1, bins: int = 16384, most: int = 1 << 17) -> None:
        self.key, self.tie, self.levels, self.parts = key, tie, [], 1
        low, high, total = df.agg(F.min(key), F.max(key), F.sum(F.col(weight).cast("double"))).first()
        if not total:
            return
        n = min(most, max(least, -(-total // part_weight)))
        goal, bins = total / n, max(bins, int(4 * n))
        width = max(1, -(-(high + 1 - low) // bins)) if low is not None else 1
        count = 1 + (-(-(high + 1 - low) // width) if low is not None else 0)
        nodes = [(False, low or 0, width, count)]  # of each level: by tie, least value, width and number of bins
        rows = df.select(F.col(key), F.col(tie), F.col(weight).cast("double").alias("w"))
        tree = self.levels = []
        while nodes:
            offsets = [0]
            for node in nodes:
                offsets.append(offsets[-1] + node[3])
            level = {"nodes": nodes, "offsets": offsets, "below": {}, "entries": [0] * offsets[-1]}
            tree.append(level)
            found = rows.select(self._found(0, F.lit(0), len(tree) - 1).alias("at"), "w").where("at is not null").groupBy("at").agg(F.sum("w"))
            level["weights"] = dict(map(tuple, found.collect()))
            heavy = []
            for i, (by_tie, start, wide, _) in enumerate(nodes):
                for at in range(offsets[i], offsets[i + 1]):
                    if level["weights"].get(at, 0.0) > goal and (wide > 1 or not by_tie):
                        one = at - offsets[i] - (len(tree) == 1)
                        heavy.append((at, by_tie, start + one * wide, wide) if by_tie or wide > 1 and one >= 0 else (at, True, 0, 1 << 63))
            finer, nodes = max(64, bins // max(1, len(heavy))), []
            for at, by_tie, start, wide in heavy:
                level["below"][at] = len(nodes)
                inner = -(-wide // finer)
                nodes.append((by_tie, start, inner, -(-wide // inner)))
            for at, child in level["below"].items():
                level["entries"][at] = -1 - child
        self._number(tree, goal)

    def _number(self, tree: list[dict], goal: float) -> None:
        filled, part = 0.0, 0

        def visit(depth: int, node: int) -> None:
            nonlocal filled, part
            level = tree[depth]
            for at in range(level["offsets"][node], level["offsets"][node + 1]):
                if at in level["below"]:
                    visit(depth + 1, level["below"][at])
                    continue
                w = level["weights"].get(at, 0.0)
                if w and filled >= goal:
                    part, filled = part + 1, 0.0
                filled += w
                level["entries"][at] = part

        visit(0, 0)
        self.parts = part + 1

    def _place(self, depth: int, node: Column) -> Column:
        """Number of the bin of a row in a node of that depth."""
        key, nodes = F.col(self.key), self.levels[depth]["nodes"]
        if depth == 0:
            _, low, width, _ = nodes[0]
            found = F.expr(f"cast((cast(`{self.key}` as decimal(20,0)) - {low}) div {width} as int)") + 1
            return F.when(key.isNull(), F.lit(0)).otherwise(found)

        def of(values: list[int], kind: str = "bigint") -> Column:
            return F.get(constants(values, kind), node)

        value = F.when(of([int(n[0]) for n in nodes], "int") == 1, F.shiftright(self.tie, 1) + F.lit(1 << 62)).otherwise(key)
        inside = F.call_function("div", value - of([n[1] for n in nodes]), of([n[2] for n in nodes]))
        return (of(self.levels[depth]["offsets"][:-1]) + inside).cast("int")

    def _found(self, depth: int, node: Column, to: int | None = None) -> Column:
        """The part of a row in a node, or its bin at depth ``to`` (null where it ends above)."""
        at = self._place(depth, node)
        if depth == to:
            return at

        def below(entry: Column) -> Column:
            found = F.when(entry < 0, self._found(depth + 1, -1 - entry, to)) if depth + 1 < len(self.levels) else F.when(F.lit(False), 0)
            return found if to is not None else found.otherwise(entry)

        # bound as a variable: written out, the expression would double with each level
        return F.get(F.transform(F.array(F.get(constants(self.levels[depth]["entries"]), at)), below), F.lit(0))

    def with_part(self, df: DataFrame) -> DataFrame:
        """df with the column part."""
        return df.withColumn("part", self._found(0, F.lit(0)) if self.levels else F.lit(0))


def constants(values: list[int], kind: str = "int") -> Column:
    """A constant array, folded once instead of an expression for each element."""
    return F.from_json(F.lit("[" + ",".join("null" if v is None else str(v) for v in values) + "]"), f"array<{kind}>")


def deal(df: DataFrame, part: str, parts: int) -> DataFrame:
    """Rows by number of part, each part a partition of its own."""
    return df.repartitionById(parts, F.col(part).cast("int"))
