"""Nearest neighbours through learned partitions.

A bounded sample's nearest-neighbour graph is cut into balanced parts (median splits along
principal directions, then moves along edges under a bound of size).  A small network learns
from each vector which parts its neighbours are in.  Every row is indexed in its most probable
part; a query goes to as many of its most probable parts as the sample needed for the wanted
recall against brute force, and all rows there are ranked by exact distances.

The number of parts follows the number of rows, and the sample the number of parts, up to
``most_sample`` vectors (131,072, with 4,096 parts, as it is); beyond four million rows parts
grow unless that parameter does.  Large parts are dealt in blocks of about ``BLOCK_BYTES``, so
that many equal vectors, or a lopsided part, never meet in one task; queries go to every block
of a part.  Products of matrices tell which rows can be nearest; these are measured exactly.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take
no part, nor do rows without vec_id or of another length than the most common one (of equally
common ones the longest).  Rows with equal vec_id, and repeated rows, count once, with their
smallest vector.  Ties go to the smaller vec_id.  A query with fewer candidates gets them all;
a sample of fewer than eight rows makes one part; an empty table gives an empty result.  Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.llm.common import constants, cut, matrix, prepare

QUERY = "op6_learned_partitions"
ORACLE_SQL = None

#: Rows that fit the partitions at least and at most, rows of a part that is aimed at, sampled rows for each part.
SAMPLE, MOST_SAMPLE, PART_ROWS, SAMPLED = 8192, 1 << 17, 1024, 32
#: Bytes of vectors in a block of a part.
BLOCK_BYTES = 8 << 20
#: Recall on the sample that sets the number of parts a query goes to.
RECALL = 0.96


def graph_of(x: np.ndarray, k: int, queries: np.ndarray | None = None) -> np.ndarray:
    """Positions of the k nearest rows of x for each query row (itself left out where queries is None)."""
    own = queries is None
    queries = x if own else queries
    square = (x * x).sum(1)
    found = np.empty((len(queries), k), np.int64)
    for a in range(0, len(queries), 512):
        d = square[None, :] - 2 * queries[a : a + 512] @ x.T
        if own:
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(x) else np.tile(np.arange(len(x)), (len(d), 1))[:, :k]
        found[a : a + 512] = near
    return found


def balanced(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 12, slack: float = 0.05) -> np.ndarray:
    """Part of each row: equal halves along principal directions, then moves that keep edges within parts."""
    part = np.zeros(len(x), np.int64)
    made = 1
    while made < parts:
        for p in range(made):
            at = np.flatnonzero(part == p)
            if len(at) < 2:
                continue
            centred = x[at] - x[at].mean(0)
            direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            order = np.argsort(centred @ direction, kind="stable")
            part[at[order[len(at) // 2 :]]] = p + made
        made *= 2
    most = int(np.ceil(len(x) / parts * (1 + slack)))
    rows = np.repeat(np.arange(len(x)), graph.shape[1])
    for _ in range(passes):
        weight = np.zeros((len(x), parts))
        np.add.at(weight, (rows, part[graph.ravel()]), 1)
        np.add.at(weight, (graph.ravel(), part[rows]), 1)
        best = weight.argmax(1)
        gain = weight[np.arange(len(x)), best] - weight[np.arange(len(x)), part]
        size = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most and i % 2 == moved % 2:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network of one hidden layer: probabilities of parts for vectors."""

    def __init__(self, parts: int) -> None:
        self.parts, self.weights = parts, None

    def learn(self, x: np.ndarray, wanted: np.ndarray, hidden: int = 128, epochs: int = 40) -> None:
        draw = np.random.RandomState(6)
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        x = ((x - self.mean) / self.scale).astype(np.float32)
        w = [draw.randn(x.shape[1], hidden).astype(np.float32) / np.sqrt(x.shape[1]), np.zeros(hidden, np.float32),
             draw.randn(hidden, self.parts).astype(np.float32) / np.sqrt(hidden), np.zeros(self.parts, np.float32)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for a in range(0, len(x), 256):
                at = order[a : a + 256]
                h = np.maximum(x[at] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                dz = (p / p.sum(1, keepdims=True) - wanted[at]) / len(at)
                dh = dz @ w[2].T * (h > 0)
                t += 1
                for i, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    g = g + 1e-4 * w[i]
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    w[i] = (w[i] - 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        self.weights = w

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        if self.weights is None:
            return np.zeros((len(x), 1), np.int64)
        w = self.weights
        h = np.maximum(((x - self.mean) / self.scale).astype(np.float32) @ w[0] + w[1], 0)
        return np.argsort(-(h @ w[2] + w[3]), axis=1, kind="stable")


def fit(x: np.ndarray, rows: int, k: int = 10, recall: float = RECALL) -> tuple[Router, int]:
    """A router for ``rows`` rows of which x is a sample, and to how many parts queries go."""
    if len(x) < 8:
        return Router(1), 1
    parts = 4
    while parts * 2 * PART_ROWS <= rows and parts * 2 * SAMPLED <= len(x):
        parts *= 2
    k = min(k, len(x) - 1)
    graph = graph_of(x, k)
    part = balanced(x, graph, parts)
    wanted = np.zeros((len(x), parts), np.float32)
    np.add.at(wanted, (np.repeat(np.arange(len(x)), k), part[graph.ravel()]), 1)
    wanted[np.arange(len(x)), part] += k / 2
    router = Router(parts)
    router.learn(x, wanted / wanted.sum(1, keepdims=True))
    ranks = router.ranked(x)
    home = ranks[:, 0]
    ask = np.random.RandomState(7).permutation(len(x))[:1024]
    place = np.argsort(ranks[ask], axis=1)  # place[q, p]: at which rank q has part p
    needed = np.take_along_axis(place, home[graph[ask]], axis=1)
    probes = next(p for p in range(1, parts + 1) if (needed < p).mean() >= recall or p == parts)
    return router, probes


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding of doubles) of rows that take part, one a vec_id."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def finite(v):
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))

    own = own.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0))
    sizes = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    own = own.where(F.size("embedding") == (sizes[0] if sizes else 0))
    return own.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def best(table: np.ndarray, ids: np.ndarray, q: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, distance) of the k rows nearest to each row of q, itself left out."""
    square, own = (table * table).sum(1), (q * q).sum(1)
    apart = square[None, :] - 2 * (q @ table.T) + own[:, None]
    apart[asked[:, None] == ids[None, :]] = np.inf
    bar = np.partition(apart, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
    slack = 1e-9 * (square.max() + own)  # far more than the products' rounding
    out: list[tuple] = []
    for i in range(len(q)):
        near = np.flatnonzero((apart[i] <= bar[i] + slack[i]) & (apart[i] < np.inf))
        exact = np.sqrt(((table[near] - q[i]) ** 2).sum(1))
        order = np.lexsort((ids[near], exact))[:k]
        out.append((np.full(len(order), asked[i]), ids[near[order]], exact[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(
    vectors: DataFrame, k: int = 10, every: int = 100, sample: int = SAMPLE, recall: float = RECALL, most_sample: int = MOST_SAMPLE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score of its k nearest found."""
    spark = vectors.sparkSession
    own = cut(usable(vectors), "vectors")
    rows = own.count()
    wanted = max(sample, min(most_sample, SAMPLED * rows // PART_ROWS))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 30))
    some = own.where(draw < min(1.0, wanted / max(1, rows)) * (1 << 30)).collect()
    some.sort()
    x = np.array([r[1] for r in some]) if some else np.zeros((0, 1))
    router, probes = fit(x, rows, k, recall)
    known = spark.sparkContext.broadcast(router)  # at most (dimensions + parts) * 128 numbers
    prepare(spark)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ranks = known.value.ranked(matrix(part.column(1)))
                asks = part.column(0).to_numpy() % every == 0
                ask = pa.array([r.tolist() if a else None for r, a in zip(ranks[:, :probes].astype(np.int32), asks, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ranks[:, 0].astype(np.int32)), ask], names=["vec_id", "embedding", "part", "ask"])

    placed = cut(own.mapInArrow(routed, "vec_id long, embedding array<double>, part int, ask array<int>"), "routed")
    counts = {r[0]: r[1] for r in placed.groupBy("part").count().collect()}
    block = max(1, block_bytes // (8 * max(1, x.shape[1])))
    blocks = [max(1, -(-counts.get(p, 0) // block)) for p in range(router.parts)]
    many = F.element_at(constants(blocks), F.col("part") + 1)
    index = placed.select("part", F.pmod(F.xxhash64("vec_id"), many).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "embedding")
    asked = placed.where("ask is not null").select(F.explode("ask").alias("part"), "vec_id", "embedding")
    asked = asked.select("part", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"), F.lit(1).alias("kind"), "vec_id", "embedding")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table, ids = None, [], []
        for batch in batches:
            part, place, kind, vec_ids = (batch.column(i).to_numpy() for i in range(4))
            vectors_ = matrix(batch.column(4))
            starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(starts, np.r_[starts[1:], len(part)], strict=True):
                if (part[a], place[a]) != at:
                    at, table, ids = (part[a], place[a]), [], []
                if kind[a] == 0:
                    table.append(vectors_[a:b])
                    ids.append(vec_ids[a:b])
                elif ids:
                    table, ids = [np.concatenate(table)], [np.concatenate(ids)]
                    for c in range(a, b, 64):
                        d = min(b, c + 64)
                        yield pa.RecordBatch.from_arrays([pa.array(y) for y in best(table[0], ids[0], vectors_[c:d], vec_ids[c:d], k)], schema=schema)

    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = index.union(asked).repartition(n, "part", "block").sortWithinPartitions("part", "block", "kind", "vec_id")
    found = met.mapInArrow(searched, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
