"""Quartile bucket digests of texts, and their bounded difference.

Byte triplets (adjacent ones, and two with a gap of one) of a text's UTF-8 are hashed into
256 buckets.  Each bucket is encoded by the quartile in which its count lies, two bits a
bucket, next to the length on a logarithmic scale.  The difference of two digests adds up
the buckets' distances (opposite quartiles count double) and the lengths', and is bounded:
likeness is 1 for equal digests and 0 from the difference on that unrelated texts have.

The next document, in descending order of doc_id, comes from one range-sorted shuffle:
the head of each part of the range is also sent to the part before it.

Defined cases: null text counts as empty (its digest has all buckets in the lowest
quartile); texts of any length are counted piece by piece; rows with equal doc_id follow each
other by hash of their text, greatest first, and repeated rows count each; rows without doc_id
come last; a single row is its own next document; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import Ranges, constants, cut, deal, map_rows

QUERY = "op2_quartile_digest"
ORACLE_SQL = None

BUCKETS = 256
#: Difference of unrelated texts, and what a step of length (a tenth) and all steps may add.
UNRELATED, LENGTH_STEP, LENGTH_MOST = 480, 2, 48
#: Bytes of a text that are counted at a time.
PIECE = 1 << 16
#: UTF-8 bytes of text in a part of the range.
PART_BYTES = 64 << 20

_SEEDED = np.random.RandomState(2)
MIX = [_SEEDED.permutation(256).astype(np.uint8) for _ in range(5)]


def digest(text: str) -> str:
    """Digest of a text: two hexadecimal digits of length, then 128 of bucket quartiles."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    n = len(data)
    for at in range(0, max(0, n - 2), PIECE):
        part = data[at : at + PIECE + 3]
        a, b, c = MIX[0][part], MIX[1][part], MIX[2][part]
        m = min(PIECE, len(part) - 2)  # triplets of neighbours that start in this piece
        counts += np.bincount(a[:m] ^ b[1 : m + 1] ^ c[2 : m + 2], minlength=BUCKETS)
        m = min(PIECE, len(part) - 3)  # and those with a gap
        if m > 0:
            d = MIX[3][part[3 : m + 3]]
            counts += np.bincount(a[:m] ^ b[1 : m + 1] ^ d, minlength=BUCKETS)
            counts += np.bincount(a[:m] ^ MIX[4][part[2 : m + 2]] ^ d, minlength=BUCKETS)
    quarter = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, None] > quarter).sum(1).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, round(math.log(n + 1) / math.log(1.1)))
    return f"{length:02x}{packed.tobytes().hex()}"


_APART = np.array([[6 if abs(a - b) == 3 else abs(a - b) for b in range(4)] for a in range(4)])
_QUADS = np.array([[i >> s & 3 for s in (6, 4, 2, 0)] for i in range(256)])
APART = _APART[_QUADS[:, None, :], _QUADS[None, :, :]].sum(2)


def difference(one: str, other: str) -> int:
    """Bounded difference of two digests: 0 if equal, ``6 * BUCKETS + LENGTH_MOST`` at most."""
    a, b = bytes.fromhex(one), bytes.fromhex(other)
    apart = APART[np.frombuffer(a, np.uint8, offset=1), np.frombuffer(b, np.uint8, offset=1)].sum()
    return int(apart) + min(LENGTH_MOST, LENGTH_STEP * abs(a[0] - b[0]))


def likeness(one: str, other: str) -> float:
    """1 for equal digests, down to 0 for unrelated ones."""
    return max(0.0, 1.0 - difference(one, other) / UNRELATED)


def with_next(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (part, doc_id, text, tail) dealt and sorted so that each row's next document follows it
    in its partition; tail marks the row that only ends a part."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("h", F.xxhash64("text"))
    small = cut(own.select("doc_id", "h", (F.octet_length("text") + 64).alias("w")), "weights")
    ranges = Ranges(small, "doc_id", "h", "w", part_bytes, least=2 * spark.sparkContext.defaultParallelism)
    own = ranges.with_part(own)
    # the head of a part is the first of its rows in the order below; null ids are the least of a struct
    heads = {r[0]: r[1] for r in ranges.with_part(small).groupBy("part").agg(F.max(F.struct("doc_id", "h"))).collect()}
    filled = sorted(heads)
    target = [None] * ranges.parts
    for p, above in zip(filled, filled[1:] + filled[:1], strict=True):
        target[p] = above
    at = F.col("part") + 1
    head_id = F.element_at(constants([heads[p][0] if p in heads else None for p in range(ranges.parts)], "bigint"), at)
    head_h = F.element_at(constants([heads[p][1] if p in heads else None for p in range(ranges.parts)], "bigint"), at)
    is_head = F.col("doc_id").eqNullSafe(head_id) & F.col("h").eqNullSafe(head_h)
    stay = F.struct(F.col("part").alias("part"), F.lit(False).alias("tail"))
    also = F.struct(F.element_at(constants(target), at).alias("part"), F.lit(True).alias("tail"))
    both = own.select("doc_id", "text", "h", F.explode(F.when(is_head, F.array(stay, also)).otherwise(F.array(stay))).alias("to"))
    return (
        deal(both.select("to.part", "to.tail", "doc_id", "h", "text"), "part", ranges.parts)
        .sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), F.desc("h"))
        .select("part", "tail", "doc_id", "text")
    )


def edited(text: str, following: str) -> str:
    """The text whose last half is the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def quartile_digests(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        held = None
        for part, tail, doc_id, text in rows:
            own = digest(text)
            if held is not None and held[0] == part:
                _, before_id, before, print_before = held
                changed = edited(before, text)
                print_changed = own if changed == text else digest(changed)
                yield (
                    before_id, len(before), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), print_before,
                    print_changed, likeness(print_before, print_changed), likeness(print_before, own),
                )
            held = None if tail else (part, doc_id, text, own)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_rows(with_next(docs, part_bytes), work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document, of its edit, and their likeness."""
    return quartile_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
