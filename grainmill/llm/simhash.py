"""SimHash near-duplicates, linked through Golay-code fuzzy hashing.

A fingerprint's 64 bits fall into three segments of 21, 21 and 22 bits, each a word of the
perfect binary Golay code [23, 12].  A segment is decoded to its nearest codeword; where
that is three bits away, five more codewords are four bits away.  A segment that differs in
one bit at most has its nearest codeword among these, so one side of a join carries all
codewords near a segment, the other side the nearest one only.

Pigeonhole over at most three differing bits: either some segment agrees wholly and another
differs in one bit at most, or each segment differs in exactly one.  So keys are (whole
segment i, codeword of segment j) for i != j, and the codewords of the first two segments
together.  Keys meet in one shuffle; pairs are verified run by run over distinct
fingerprints, and each task keeps only links that join what it has not joined yet, so that a
group of near copies yields a tree rather than its pairs.  A run is read as a stream: only
its rows by nearest codeword are held, and where a key has very many of these they are dealt
over blocks, each of which meets all others of the key.  Trees grow into components by
alternating large and small stars until nothing changes, written to the shared folder after
each round; nodes with many edges are spread over tasks by salts.  The pipeline's stage joins
its links in the driver where they are few, counted first.

The pipeline's stage links texts by the similarity of their sets of shingles.  Texts whose
fingerprints the Golay keys link are its first candidates.  Three bits lose pairs that are
less alike, so an exact path finds the rest: in one order of all shingles, two sets of a
similarity of ``t`` share one of their first n - ceil(t n) + 1 shingles.  In a few rounds some
texts of each of these keys meet the others that they are not joined to; what is in different
components after that is paired key by key.  A sketch of parities, which never differs in more
bits than two sets in elements, spares most pairs that are too far apart.  Every link, also
those of the fingerprints, is decided by the two whole sets.

Defined cases: null text counts as empty; texts without words have fingerprint 0 and link
like any other; texts may have any length (hashed piece by piece); rows with equal doc_id,
and repeated rows, each get their fingerprint (the stage keeps one of them); a row without
doc_id never lends its id to a component, and a component of such rows only has id null; of
tied ids the text with the smaller hash leads; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import DOCUMENT_COLUMNS, cut, map_rows, prepare, spread_join

QUERY = "op9_simhash_golay"
ORACLE_SQL = None

#: Words of a shingle, differing bits that link, hash seed.
WORDS, BITS, SEED = 3, 3, 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints that a task remembers to have joined; then it gives their links and starts afresh.
JOINED = 500_000
#: Rows of a key that one task holds: keys of more are dealt over blocks.
HOLD = 1 << 16
#: One fingerprint of so many tells which keys are hot.
SAMPLE = 64
#: One text of so many tells which shingles are common: those that this many of them have; so many at most count.
COMMON_SAMPLE, COMMON_TEXTS, COMMON = 8, 2, 250_000
#: Bits of a set's parity sketch; how many rows of a key meet all others, round by round.
SKETCH, CENTRES = 512, (4, 64)
#: Ends of pairs that are broadcast to pick their texts (some 10 MB at most); the texts meet more of them in a shuffle.
ENDS = 250_000
#: Distinct links that the pipeline's stage joins in the driver (4 MB at most); more go through the rounds of stars.
EDGES = 250_000


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash over all shingles, repeats included."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    if not own:
        return 0
    line = b" ".join(own)
    ends = (np.cumsum([len(w) + 1 for w in own]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[words - 1 :] or ends[-1:]
    n, counts = len(last), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        some = zip(starts[at : at + (1 << 14)], last[at : at + (1 << 14)], strict=False)
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in some], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def signed(fp: int) -> int:
    """The same 64 bits as a signed number."""
    return fp - (1 << 64) if fp >> 63 else fp


class Golay:
    """Decoding tables of the code with generator x^11+x^9+x^7+x^6+x^5+x+1, made by rule."""

    def __init__(self, generator: int = 0xAE3) -> None:
        def rest(v: int) -> int:
            for i in range(22, 10, -1):
                if v >> i & 1:
                    v ^= generator << (i - 11)
            return v

        single = [rest(1 << i) for i in range(23)]
        self.low = self._table(single[:12])
        self.high = self._table(single[12:])
        self.leader = np.zeros(2048, np.int64)
        self.far = np.zeros(2048, bool)
        fours: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(1, 5):
            for at in combinations(range(23), weight):
                word, syndrome = 0, 0
                for i in at:
                    word |= 1 << i
                    syndrome ^= single[i]
                if weight < 4:
                    self.leader[syndrome] = word
                    self.far[syndrome] = weight == 3
                else:
                    fours[syndrome].append(word)
        self.fours = np.array([f if f else [0] * 5 for f in fours], np.int64)

    @staticmethod
    def _table(single: list[int]) -> np.ndarray:
        table = np.zeros(1, np.int64)
        for s in single:
            table = np.concatenate((table, table ^ s))
        return table

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword's index, indices of five more, and whether those count."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words ^ self.leader[syndrome]) >> 11, (words[:, None] ^ self.fours[syndrome]) >> 11, self.far[syndrome]


_GOLAY: list[Golay] = []


def keys_of(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, positions of their fingerprints, whether they carry all near codewords) of unsigned fingerprints."""
    if not _GOLAY:
        _GOLAY.append(Golay())
    parts = [(prints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [_GOLAY[0].near(p) for p in parts]
    own = np.arange(len(prints))
    # six columns of candidates; those that do not count are -1
    six = [np.c_[one, np.where(far[:, None], five, -1)] for one, five, far in near]
    for kind, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        head = (kind << 34 | parts[i] << 12)[:, None]
        yield (head | near[j][0][:, None]).ravel(), own, False
        kept = six[j] >= 0
        yield (head | six[j])[kept], np.repeat(own, kept.sum(1)), True
    a, b = six[0][:, :, None], six[1][:, None, :]
    both = np.where((a >= 0) & (b >= 0), a << 12 | b, -1).reshape(len(prints), -1)
    kept = both >= 0
    yield near[0][0] << 12 | near[1][0] | 6 << 37, own, False
    yield (both | 6 << 37)[kept], np.repeat(own, kept.sum(1)), True


class Joined:
    """Union-find over fingerprints; says which links join anything new."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        path = []
        while (up := above.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            above[p] = x
        return x

    def new(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.above[max(a, b)] = min(a, b)
        return True

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join pairs; many pairs of few groups cost one look for each fingerprint."""
        both, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        roots = np.array([self.root(x) for x in both.tolist()], np.uint64)[at]
        x, y = roots[: len(a)], roots[len(a) :]
        apart = x != y
        for u, v in set(zip(x[apart].tolist(), y[apart].tolist(), strict=True)):
            self.new(u, v)

    def stars(self) -> list[tuple[int, int]]:
        """All that was joined, each fingerprint linked to the smallest one that it reaches: tasks that
        meet the same group mostly give the same links."""
        return [(x, self.root(x)) for x in list(self.above)]


def meet(near: np.ndarray, all_: np.ndarray, bits: int, known: Joined) -> None:
    """Join the fingerprints of one run, some against some at a time."""
    for a in range(0, len(near), 256):
        x = near[a : a + 256]
        for b in range(0, len(all_), 4096):
            y = all_[b : b + 4096]
            apart = np.bitwise_count(x[:, None] ^ y[None, :])
            i, j = np.nonzero((apart <= bits) & (apart > 0))
            if len(i):
                known.join(x[i], y[j])


LINK_KEYS = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("all", pa.bool_()), ("fp", pa.int64())])


def links(prints: DataFrame, bits: int = BITS, hold: int = HOLD, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) of the distinct fingerprints fp that span the same components as all pairs that differ in
    at most ``bits`` bits (three at most).

    One fingerprint of ``sample`` tells which keys have more than ``hold`` rows, of which a task would hold those by nearest
    codeword: they are dealt over blocks.  A key that the sample misses is merely held longer.
    """
    spark = prints.sparkSession
    prepare(spark)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 2048):
                for keys, _, side in keys_of(fps[at : at + 2048]):
                    if not side:
                        yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    some = prints.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0).select("fp").mapInArrow(sampled, "key long")
    often = some.groupBy("key").count().where(F.col("count") * sample > hold).collect()
    hot = dict(sorted((r[0], -(-r[1] * sample // hold)) for r in often))
    hot_keys, hot_blocks = (spark.sparkContext.broadcast(np.array(list(x), np.int64)) for x in (hot.keys(), hot.values()))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 2048):
                own = fps[at : at + 2048]
                for keys, rows, side in keys_of(own.view(np.uint64)):
                    blocks = np.zeros(len(keys), np.int64)
                    if len(hot_keys.value):
                        place = np.minimum(np.searchsorted(hot_keys.value, keys), len(hot_keys.value) - 1)
                        many = np.where(hot_keys.value[place] == keys, hot_blocks.value[place], 1)
                        if side:  # to every block
                            blocks = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                            keys, rows = np.repeat(keys, many), np.repeat(rows, many)
                        else:
                            blocks = (own[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % many
                    columns = [keys, blocks.astype(np.int32), np.full(len(keys), side), own[rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=LINK_KEYS)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Joined()
        rest = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, bool), np.empty(0, np.uint64)]
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def given() -> Iterator[pa.RecordBatch]:
            stars = known.stars()
            for at in range(0, len(stars), 1 << 14):
                pairs = np.array(stars[at : at + (1 << 14)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)
            known.above.clear()

        def of(starts: np.ndarray, sizes: np.ndarray, all_: np.ndarray, fps: np.ndarray) -> None:
            n_all = np.add.reduceat(all_.astype(np.int64), starts)
            n_near = sizes - n_all
            some = (n_all > 0) & (n_near > 0) & (sizes > 2)
            small = some & (n_all * n_near <= 64)
            # rows of a run: nearest codewords first, then all of them
            if small.any():
                s, a, n = starts[small], n_all[small], n_near[small]
                each = a * n
                run = np.repeat(np.arange(len(s)), each)
                within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                x, y = fps[s[run] + within % n[run]], fps[s[run] + n[run] + within // n[run]]
                found = np.flatnonzero((np.bitwise_count(x ^ y) <= bits) & (x != y))
                if len(found):
                    known.join(x[found], y[found])
            for k in np.flatnonzero(some & ~small):
                middle = starts[k] + n_near[k]
                meet(fps[starts[k] : middle], fps[middle : starts[k] + sizes[k]], bits, known)

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            new[3] = new[3].view(np.uint64)
            key, block, all_, fps = (np.concatenate(x) for x in zip(rest, new, strict=True))
            if not len(key):
                continue
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            last = starts[-1]  # the last run may go on
            if last:
                of(starts[:-1], np.diff(starts), all_[:last], fps[:last])
            rest = [key[last:], block[last:], all_[last:], fps[last:]]
            if rest[2].sum() > 1 << 16:  # a long run: what came by all codewords has met those that are held
                meet(rest[3][~rest[2]], rest[3][rest[2]], bits, known)
                rest = [r[~rest[2]] for r in rest]
            if len(known.above) > JOINED:
                yield from given()
        if len(rest[0]):
            of(np.array([0]), np.array([len(rest[0])]), rest[2], rest[3])
        yield from given()

    keys = prints.select("fp").mapInArrow(keyed, "key long, block int, all boolean, fp long")
    return keys.repartition(_tasks(spark), "key", "block").sortWithinPartitions("key", "block", "all").mapInArrow(joined, "a long, b long")


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def least_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that reaches a smaller one, and the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j, above = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := above[i] != above[j]).any():
        x, y = above[i[apart]], above[j[apart]]  # roots
        np.minimum.at(above, np.maximum(x, y), np.minimum(x, y))
        while ((up := above[above]) != above).any():
            above = up
    lower = above != np.arange(len(nodes))
    return nodes[lower], nodes[above[lower]]


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) of every node with a smaller root: alternating large and small stars until nothing changes.
    Up to ``few`` distinct edges, counted first, are joined in the driver instead, which spares the rounds."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = now.agg(state).first()[0]
    if 0 < before[0] <= few:
        held = now.toArrow()
        node, root = least_joined(held.column("u").to_numpy(), held.column("v").to_numpy())
        return now.sparkSession.createDataFrame(pa.table({"node": node, "root": root}))
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both.where("v > u"), least, "u", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u", before[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        after = now.agg(state).first()[0]
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Per row of docs: doc_id, fingerprint, component_id (the smallest doc_id reachable)."""

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, h in rows:
            yield doc_id, h, signed(fingerprint(text, words))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut(map_rows(own.withColumn("h", F.xxhash64("text")), work, "doc_id long, h long, fp long", chunk=4096), "prints")
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = cut(prints.groupBy("fp").agg(F.min(lead).alias("lead")), "classes")
    roots = components(links(classes, bits))
    rooted = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lead", F.coalesce("root", "fp").alias("root")), "rooted")
    leads = rooted.groupBy("root").agg(F.min("lead").alias("first"))
    found = spread_join(rooted.select("fp", "root"), leads, "root", rooted.count()).select("fp", "first")
    rows = spread_join(prints.select("doc_id", "fp"), found, "fp", prints.count())
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the set of a text's shingles; a shorter text is one shingle, an empty one as well."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    line = b" ".join(own)
    ends = (np.cumsum([len(w) + 1 for w in own]) - 1).tolist() or [0]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[words - 1 :] or ends[-1:]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, len(last)))


def least_of(n: int, similarity: float) -> int:
    """Fewest shingles that a set of n shares with one as similar."""
    return math.ceil(similarity * n - 1e-9)


def first_keys(own: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """First shingles of a set, of which two sets so similar share one.  The order is by hash, ``common`` ones
    (sorted, and how often each was found) last, the more frequent the later."""
    keys, counts = common
    often = np.zeros(len(own), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        often = np.where(keys[at] == own, counts[at], 0)
    return own[np.lexsort((own, often))][: len(own) - least_of(len(own), similarity) + 1]


def set_print(own: np.ndarray) -> int:
    """64-bit SimHash of a set of hashes, as a signed number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 14):
        some = own[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(own), bitorder="little").view("<i8")[0])


def sketch(own: np.ndarray) -> np.ndarray:
    """Parities of the counts of hashes by their last bits: sketches of two sets differ in no more bits than the sets in elements."""
    return np.packbits(np.bincount((own % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1).view(np.uint64)


def sketches(column: pa.Array) -> np.ndarray:
    """Sketches of a batch, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), SKETCH // 64)


KEY_SCHEMA = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int32())])
PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int32()), ("nb", pa.int32()), ("c", pa.int64())])


def packed_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs, the smaller node first, with the number of times that each is there."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    counts = np.diff(np.r_[starts, len(a)])
    for at in range(0, len(starts), 1 << 14):
        k = starts[at : at + (1 << 14)]
        columns = [a[k], b[k], na[k].astype(np.int32), nb[k].astype(np.int32), counts[at : at + (1 << 14)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=PAIR_SCHEMA)


def print_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, fp): those of one fingerprint with its first, and first ones as the Golay keys link them."""
    first = cut(prints.groupBy("fp").agg(F.min("node").alias("first")), "firsts")
    same = spread_join(prints, first, "fp", prints.count()).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = cut(links(first), "print_links")
    rows = found.count()
    for end in ("a", "b"):
        found = spread_join(found, first.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end, rows)
    return same.union(found.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")))


def set_links(
    texts: DataFrame, words: int, similarity: float, hold: int = HOLD, ends_most: int = ENDS, edges_most: int = EDGES,
    texts_of: Callable[[DataFrame, bool], DataFrame] | None = None,
) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of texts (node, text; equal nodes have equal
    texts) whose sets of shingles have that Jaccard similarity or more.  None is lost, and each link has it.

    A task holds at most about ``hold`` rows of a key: keys of more are dealt over blocks, and each two blocks meet.
    ``texts_of`` gives the texts of a table of nodes, of which its second argument says whether they are few enough
    (``ends_most``) to broadcast; it spares another run of the whole plan of ``texts`` where that is costly.
    ``edges_most``: see components.
    """
    spark = texts.sparkSession
    prepare(spark)
    tasks = _tasks(spark)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own = shingles(batch.column(1)[at].as_py(), words).view(np.int64)
                one = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), one], names=["node", "own"])

    # frequent shingles of a sample go last in the order: any order finds all pairs, this one in shorter runs
    def counted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(batch.column(0)[at].as_py(), words).view(np.int64))], names=["key"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(COMMON_SAMPLE)) == 0).select("text").mapInArrow(counted_sets, "key long")
    often = some.groupBy("key").count().where(F.col("count") >= COMMON_TEXTS).orderBy(F.desc("count"), "key").limit(COMMON)
    found = often.toArrow()
    keys_, counts_ = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(keys_)
    common = spark.sparkContext.broadcast((keys_[order], counts_[order]))  # 4 MB at most

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The fingerprint and sketch of each text (n is 0), and its first shingles."""
        schema = KEY_SCHEMA.append(pa.field("bits", pa.binary()))
        for batch in batches:
            for at in range(batch.num_rows):
                own = shingles(batch.column(1)[at].as_py(), words)
                keys = np.r_[set_print(own), first_keys(own, similarity, common.value).view(np.int64)]
                n, bits = np.full(len(keys), len(own), np.int32), pa.array([sketch(own).tobytes(), *[None] * (len(keys) - 1)], pa.binary())
                n[0] = 0
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (keys, np.full(len(keys), batch.column(0)[at].as_py(), np.int64), n)), bits], schema=schema)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key is there twice."""
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        again = False  # the row kept back has a key that was given already
        for batch in batches:
            rows = [np.concatenate((r, c.to_numpy())) for r, c in zip(rest, batch.columns, strict=True)]
            if not len(rows[0]):
                continue
            same = rows[0][1:] == rows[0][:-1]
            kept = np.r_[again, same][:-1] | same
            yield pa.RecordBatch.from_arrays([pa.array(r[:-1][kept]) for r in rows], schema=KEY_SCHEMA)
            again = bool(same[-1]) if len(same) else again
            rest = [r[-1:] for r in rows]
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rest], schema=KEY_SCHEMA)

    def alike(n: np.ndarray, root: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs can be as similar: by their sizes, and by the elements in which they differ at least."""
        kept = np.flatnonzero((root[i] != root[j]) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9))
        i, j = i[kept], j[kept]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)
        return kept[apart <= (n[i].astype(np.int64) + n[j]) * (1 - similarity) / (1 + similarity) + 1e-6]

    def stars(batches: Iterator[pa.RecordBatch], centres: int) -> Iterator[pa.RecordBatch]:
        """Pairs of the first rows of a run and all after them that are not joined to them."""
        first = [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.int64)] + [np.empty((0, SKETCH // 64), np.uint64)]
        for batch in batches:
            new = [*(c.to_numpy() for c in batch.columns[:5]), sketches(batch.column(5))]
            for at in range(0, batch.num_rows, 1 << 14):
                key, block, node, n, root, bits = (np.concatenate((r, c[at : at + (1 << 14)])) for r, c in zip(first, new, strict=True))
                starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
                own = np.repeat(starts, np.diff(np.r_[starts, len(key)]))
                for c in range(centres):
                    j = np.flatnonzero(np.arange(len(key)) > own + c)
                    if not len(j):
                        break
                    i = own[j] + c
                    kept = alike(n, root, bits, i, j)
                    i, j = i[kept], j[kept]
                    yield from packed_pairs(node[i], node[j], n[i], n[j])
                first = [x[starts[-1] :][:centres] for x in (key, block, node, n, root, bits)]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of a run that are not joined, some rows against the run at a time; they leave counted."""
        held: list[list[np.ndarray]] = []

        def given() -> Iterator[pa.RecordBatch]:
            if held:
                yield from packed_pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()

        def of(cell: np.ndarray, side: np.ndarray, node: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            if (root == root[0]).all():
                return
            within = cell[0] >> 32 == cell[0] & 0xFFFFFFFF  # one block with itself, else two with each other
            step = max(1, (1 << 18) // len(node))
            for at in range(0, len(node), step):
                x, y = slice(at, at + step), slice(at, None)
                good = root[x, None] != root[None, y]
                i, j = np.nonzero(good if within else good & (side[x, None] != side[None, y]))
                i, j = i[i < j] + at, j[i < j] + at
                kept = alike(n, root, bits, i, j)
                i, j = i[kept], j[kept]
                if len(i):
                    held.append([node[i], node[j], n[i], n[j]])
                    if sum(len(h[0]) for h in held) > 1 << 18:
                        yield from given()

        rest = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int64, np.int32, np.int64)] + [np.empty((0, SKETCH // 64), np.uint64)]
        for batch in batches:
            new = [*(c.to_numpy() for c in batch.columns[:6]), sketches(batch.column(6))]
            rows = [np.concatenate((r, c)) for r, c in zip(rest, new, strict=True)]
            if not len(rows[0]):
                continue
            starts = np.flatnonzero(np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield from of(*(r[a:b] for r in rows[1:]))
            rest = [r[starts[-1] :] for r in rows]
        if len(rest[0]):
            yield from of(*rest[1:])
        yield from given()

    def counted(found: DataFrame, share: float) -> DataFrame:
        """Pairs that share so many keys that they can be as similar: beyond its keys, one set of the two has all others at most."""
        def others(n: str) -> Column:
            return F.ceil(F.lit(similarity) * F.col(n) - 1e-9) - 1

        needed = similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-6 - F.greatest(others("na"), others("nb"))
        own = found.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("c").alias("c"))
        return own.where(F.col("c") >= share * needed).select("a", "b")

    def verified(edges: DataFrame) -> DataFrame:
        """Those pairs whose sets are as similar."""
        edges = cut(edges, "pairs")
        ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        rows = edges.count()
        few = 2 * rows <= ends_most
        some = texts_of(ends, few) if texts_of else texts.join(F.broadcast(ends) if few else ends, "node", "left_semi")
        own = cut(some.select("node", "text").mapInArrow(sets, "node long, own array<long>").dropDuplicates(["node"]), "sets")
        both = spread_join(edges, own.select(F.col("node").alias("a"), F.col("own").alias("one")), "a", rows)
        both = spread_join(both, own.select(F.col("node").alias("b"), F.col("own").alias("other")), "b", rows, by="a")
        same = F.size(F.array_intersect("one", "other"))
        return cut(both.where(same >= similarity * (F.size("one") + F.size("other") - same) - 1e-9).select("a", "b"), "links")

    raw = cut(texts.mapInArrow(keyed, "key long, node long, n int, bits binary"), "shingles")
    nodes = cut(raw.where("n = 0").groupBy("node").agg(F.first("key").alias("fp"), F.first("bits").alias("bits")), "nodes")
    near = print_pairs(nodes.select("node", "fp"))
    keys = raw.where("n > 0").select("key", "node", "n").repartition(tasks, "key").sortWithinPartitions("key")
    keys = cut(keys.mapInArrow(shared, "key long, node long, n int"), "keys")
    hot = cut(keys.groupBy("key").count().where(F.col("count") > hold).select("key", F.ceil(F.col("count") / hold).alias("blocks")), "hot")
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
    keys = keys.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    schema = "a long, b long, na int, nb int, c long"
    roots, found = None, None
    for i, centres in enumerate(CENTRES):
        known = nodes.select("node", "bits", F.col("node").alias("root")) if roots is None else nodes.select("node", "bits").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = keys.join(known, "node").select("key", "block", "node", "n", "root", "bits", F.xxhash64(F.lit(i), "node").alias("turn"))
        dealt = own.repartition(tasks, "key", "block").sortWithinPartitions("key", "block", "turn").drop("turn")
        some = counted(dealt.mapInArrow(lambda batches, n=centres: stars(batches, n), schema), 0.5)
        some = verified(some if found is not None else some.union(near).distinct())
        roots = cut(components(some if roots is None else some.union(roots.toDF("a", "b")), edges_most), "roots")
        found = some if found is None else found.union(some)
    left = keys.join(nodes.select("node", "bits").join(roots, "node", "left"), "node").withColumn("root", F.coalesce("root", "node"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    left = left.withColumn("other", other).select(
        "key", (F.least("block", "other").cast("long") * (1 << 32) + F.greatest("block", "other")).alias("cell"),
        (F.col("block") > F.col("other")).cast("int").alias("side"), "node", "n", "root", "bits",
    )
    dealt = left.repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell").select("key", "cell", "side", "node", "n", "root", "bits")
    return found.union(verified(counted(dealt.mapInArrow(pairs, schema), 1.0)))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, ends_most: int = ENDS, edges_most: int = EDGES) -> DataFrame:
    """One document of each component, unchanged: that with the smallest doc_id (of equal ids, by hash of the text).

    Texts of at least that similarity over shingles of ``words`` words are linked, and no others.  Null texts count
    as empty ones and link with these only; of rows without doc_id one stays if its whole component has none;
    of rows that repeat with id and text one stays; an empty table gives an empty one.  ``ends_most``, ``edges_most``: see set_links.
    """
    own = docs.select(*DOCUMENT_COLUMNS).withColumn("h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = cut(own.select(F.col("doc_id").cast("long").alias("doc_id"), "h"), "rows")
    lead = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = cut(rows.groupBy("h").agg(F.min(lead).alias("lead")), "classes")

    def of(leads: DataFrame, few: bool = False) -> DataFrame:
        leads = leads.select("lead.doc_id", "lead.h")
        leads = (F.broadcast(leads) if few else leads).alias("leads")
        same = F.col("own.doc_id").cast("long").eqNullSafe(F.col("leads.doc_id")) & (F.col("own.h") == F.col("leads.h"))
        return own.alias("own").join(leads, same, "left_semi")

    def texts(leads: DataFrame, few: bool = False) -> DataFrame:
        return of(leads, few).select(F.col("h").alias("node"), F.col("text").cast("string").alias("text"))

    def texts_of(nodes: DataFrame, few: bool) -> DataFrame:
        nodes = nodes.withColumnRenamed("node", "h")
        return texts(classes.join(F.broadcast(nodes) if few else nodes, "h", "left_semi"), few)

    found = set_links(texts(classes), words, similarity, ends_most=ends_most, edges_most=edges_most, texts_of=texts_of)
    roots = components(found, edges_most).withColumnRenamed("node", "h")
    rooted = classes.join(roots, "h", "left").groupBy(F.coalesce("root", "h").alias("root")).agg(F.min("lead").alias("lead"))
    kept = of(rooted)
    if not rows.groupBy("doc_id", "h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "h"])  # rows that repeat with id and text; else texts need no second shuffle
    return kept.select(*DOCUMENT_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
