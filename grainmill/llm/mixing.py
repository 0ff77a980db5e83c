"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

A document's size is its number of words.  Sources in code-point order (null last) weigh
1, 2, 3, repeating, and share the sizes' sum; a target stops at three times its source's
size and the excess is shared by weight again until none is above.  The mix consists of
blocks of ``block`` words.  Blocks go to sources one by one, each to the highest quotient
target / (2 * blocks so far + 1); shards are runs of ``shard_blocks`` such awards, so that
every shard has integer quotas of its own in the targets' proportions.  A source's words
stand in a seeded order of its documents, cut into blocks; the order is cut into the source's
shards, each with blocks in proportion to its quota, and a seeded affine walk over each shard's
blocks selects as many as that shard's quota says, in whole rounds first.  A block comes three
times at most: what a shard's blocks cannot give goes to the source's next shard.  A document
takes the words that it shares with the selected blocks, and carries from which shards.

Nothing gathers a source's documents: prefix sums run within slices of a source by hash,
and over the slices' sums; documents meet their shards by stretches of blocks.  The quotas of n
sources need 2n quotients per shard, ranked shard by shard over the tasks: a quotient level
bounds from below what every source is sure of, and only the awards between that level and the
next are ranked.

Defined cases: null text has size 0; empty documents take nothing; texts may have any length; a
null source is a source of its own; rows with equal doc_id are ordered by hash of their text and
count each (rows with equal doc_id and text share one plan in the mixed documents); empty tables
give empty results; no words at all give targets of 0; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.llm.common import DOCUMENT_COLUMNS, cut

QUERY = "op8_sainte_lague_mix"

#: Words of a block, blocks of a shard, times that a source repeats at most, weights by rank.
BLOCK, SHARD_BLOCKS, MOST, WEIGHTS = 32, 1 << 16, 3, (1, 2, 3)
SEED = "mix-1"
#: Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that slice a source's documents: about so many documents in a slice.
SLICE_ROWS = 2000


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _number(text: str) -> Column:
    """First 15 hexadecimal digits of the MD5 of an expression, as a number."""
    return F.conv(F.substring(F.md5(F.expr(text)), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources (skey, source_size) with rank, weight and target: one row a source.

    A cap binds first where cap / weight is least.  With sources in that order, the level at
    which the others share is the first, and so the highest, that is not above the next ratio.
    """
    everything = Window.orderBy("skey")
    ranked = sources.withColumn("rank", F.row_number().over(everything) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("ratio", F.lit(float(MOST)) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("capped", F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("left_weight"))
    )
    found = ranked.withColumn("share", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole))
    return found.select(
        "skey", "source_size", "rank", "total", F.count("*").over(whole).alias("n_sources"),
        F.least(MOST * F.col("source_size").cast("double"), F.coalesce(F.col("share") * F.col("weight"), F.lit(0.0))).alias("target"),
    )


def quotas(wanted: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """wanted (skey, source_size, rank, total, target, n_sources) with shard, so_far and quota: one row a source and shard.

    At the boundary of each shard the awards so far are counted: those above a level that is
    certain, and the highest among the next ones.  Shards are dealt over tasks by runs of 1,024.
    """
    rows = (
        wanted.withColumn("blocks", F.floor(F.col("total") / block)).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("blocks") / shard_blocks)))
        .withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shards") - 1) / 1024)))).repartition("skey", "run")
        .withColumn("shard", F.explode(F.sequence(F.col("run") * 1024 + 1, F.least((F.col("run") + 1) * 1024, "shards")))).drop("run", "shards")
        .withColumn("awards", F.least(F.col("blocks"), F.col("shard") * shard_blocks))
        .withColumn("low", F.when(2 * F.col("awards") > F.col("n_sources"), F.greatest(F.lit(0), F.floor(
            (F.col("target") * (2 * F.col("awards") - F.col("n_sources")) / F.col("total") + 1) / 2) - 1)).otherwise(F.lit(0)).cast("long"))
        .withColumn("high", F.when(F.col("total") > 0, F.ceil(
            (F.col("target") * (2 * F.col("awards") + F.col("n_sources")) / F.col("total") + 1) / 2) + 1).otherwise(F.lit(0)).cast("long"))
    )
    each = Window.partitionBy("shard")
    rows = rows.withColumn("open", F.col("awards") - F.sum("low").over(each))
    order = each.orderBy(F.desc("quotient"), "rank")
    next_ones = (
        rows.withColumn("j", F.explode(F.sequence(F.col("low"), F.col("high"))))
        .withColumn("quotient", F.col("target") / (2 * F.col("j") + 1))
        .withColumn("at", F.row_number().over(order))
        .groupBy("skey", "shard")
        .agg(
            F.first("source_size").alias("source_size"), F.first("target").alias("target"),
            (F.first("low") + F.sum(F.when((F.col("at") <= F.col("open")) & (F.col("quotient") > 0), 1).otherwise(0))).cast("long").alias("so_far"),
        )
    )
    by_source = Window.partitionBy("skey").orderBy("shard")
    return next_ones.withColumn("quota", F.col("so_far") - F.coalesce(F.lag("so_far").over(by_source), F.lit(0)))


def primes_from(start: int, count: int) -> list[int]:
    """The first primes from ``start`` on."""
    found = []
    while len(found) < count:
        if all(start % d for d in range(2, int(start**0.5) + 1)):
            found.append(start)
        start += 1
    return found


#: Steps of the walk: primes, so that one that does not divide a shard's number of blocks visits each block once.  A
#: shard has about ``SHARD_BLOCKS`` blocks of all sources together, so that a block's number times a step fits 64 bits.
STEPS = primes_from(82_951_000, 4)


def shards_of(awarded: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """One row (skey, shard, c0, n, quota, rounds, extra, start, step, stretch) for each source and shard with blocks.

    The shard has the blocks [c0, c0 + n) of its source, of which the walk takes each ``rounds`` times and
    ``extra`` once more.  ``stretch`` is the source's blocks for each of its shards.
    """
    by_source, upto = Window.partitionBy("skey"), Window.partitionBy("skey").orderBy("shard")
    n, all_ = F.ceil(F.col("source_size") / block).cast("decimal(19,0)"), F.col("all").cast("decimal(19,0)")
    end = F.call_function("div", n * F.col("so_far").cast("decimal(18,0)") + all_ - 1, F.nullif(all_, F.lit(0).cast("decimal(19,0)")))
    ends = (
        awarded.select("skey", "shard", "source_size", "so_far", F.max("so_far").over(by_source).alias("all"))
        .withColumn("end", F.coalesce(end, F.lit(0)))
        .withColumn("given", MOST * F.col("end") + F.least(F.lit(0), F.min(F.col("so_far") - MOST * F.col("end")).over(upto)))
    )
    number = F.col("n")
    return (
        ends.withColumn("c0", F.lag("end", 1, 0).over(upto)).withColumn("quota", F.col("given") - F.lag("given", 1, 0).over(upto))
        .withColumn("n", F.col("end") - F.col("c0")).where("n > 0")
        .withColumn("rounds", F.floor(F.col("quota") / number).cast("long")).withColumn("extra", F.col("quota") % number)
        .withColumn("start", _number(f"concat('{seed}:', skey, ':', cast(shard as string))") % number)
        .withColumn("step", F.coalesce(*[F.when(number % p != 0, F.lit(p).cast("long")) for p in STEPS], F.lit(1).cast("long")))
        .withColumn("stretch", F.ceil(F.sum("n").over(by_source) / F.count("*").over(by_source)).cast("long"))
        .select("skey", "shard", "c0", "n", "quota", "rounds", "extra", "start", "step", "stretch")
    )


def times(shard: Column, b: Column) -> Column:
    """How often the shard (a struct) takes the source's block b."""
    walk = F.pmod((b - shard.c0) * shard.step + shard.start, shard.n)
    return shard.rounds + F.when(walk < shard.extra, 1).otherwise(0)


def planned(docs: DataFrame, block: int = BLOCK, seed: str = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Per row of docs: doc_id, h, size, source_size, target, taken, shards ("shard:words" of each that it takes words
    from, joined), first (the row's first word in its source) and own, the shards that its words lie in.
    One pass over the texts: sizes are written once, then small columns only."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string"))).alias("skey"),
        size_of(F.col("text").cast("string")).alias("size"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"),
    )
    own = own.withColumn("slot", _number(f"concat('{seed}:', coalesce(cast(doc_id as string), ''))"))
    own = cut(own, "sizes")
    rows = own.count()
    slices = 1 << max(6, min(20, (rows // SLICE_ROWS).bit_length()))
    own = own.withColumn("slice", F.shiftright("slot", 60 - (slices.bit_length() - 1)).cast("int"))
    parts = cut(own.groupBy("skey", "slice").agg(F.sum("size").alias("size")), "slices")
    wanted = cut(targets(parts.groupBy("skey").agg(F.sum("size").alias("source_size"))), "targets")
    shards = cut(shards_of(quotas(wanted, block, shard_blocks), block, seed), "shards")
    sources = wanted.select("skey", "source_size", "target").join(shards.groupBy("skey").agg(F.first("stretch").alias("stretch")), "skey", "left")
    slices_before = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("skey", "slice", F.coalesce(F.sum("size").over(slices_before), F.lit(0)).alias("offset")).join(sources, "skey")
    docs_before = Window.partitionBy("skey", "slice").orderBy("slot", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("before", F.coalesce(F.sum("size").over(docs_before), F.lit(0))).join(offsets, ["skey", "slice"])
    # words [first, last) of the source, in its blocks [b0, b1]
    placed = placed.withColumn("first", F.col("offset") + F.col("before")).select(
        "skey", "doc_id", "h", "size", "source_size", "target", "first", F.coalesce("stretch", F.lit(1)).alias("stretch"),
        F.floor(F.col("first") / block).cast("long").alias("b0"), F.floor((F.col("first") + F.col("size") - 1) / block).cast("long").alias("b1"),
    )

    def stretches(low: Column, high: Column) -> Column:
        return F.explode(F.sequence(F.floor(low / F.col("stretch")), F.floor(high / F.col("stretch"))))

    # documents and shards meet in the first stretch of blocks that both are in
    spread = shards.withColumn("at", stretches(F.col("c0"), F.col("c0") + F.col("n") - 1))
    spread = spread.select("skey", "at", F.struct("shard", "c0", "n", "rounds", "extra", "start", "step").alias("one"))
    some = placed.where("size > 0").withColumn("at", stretches(F.col("b0"), F.col("b1"))).join(spread, ["skey", "at"], "left")
    meets = (F.col("one.c0") <= F.col("b1")) & (F.col("one.c0") + F.col("one.n") > F.col("b0"))
    meets = meets & (F.col("at") == F.floor(F.greatest("b0", F.col("one.c0")) / F.col("stretch")))
    found = some.groupBy("skey", "first").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "h", "size", "source_size", "target", "b0", "b1")], F.sort_array(F.collect_list(F.when(meets, F.col("one")))).alias("own")
    )

    def words(shard: Column) -> Column:
        def shared(b: Column) -> Column:
            return F.least(F.col("first") + F.col("size"), (b + 1) * block) - F.greatest(F.col("first"), b * block)

        blocks = F.sequence(F.greatest(F.col("b0"), shard.c0), F.least(F.col("b1"), shard.c0 + shard.n - 1))
        return F.aggregate(blocks, F.lit(0).cast("long"), lambda sum_, b: sum_ + shared(b) * times(shard, b))

    found = found.withColumn("parts", F.filter(F.transform("own", lambda s: F.struct(s.shard.alias("shard"), words(s).alias("words"))), lambda x: x.words > 0))
    shown = F.array_join(F.transform("parts", lambda x: F.concat_ws(":", x.shard.cast("string"), x.words.cast("string"))), ",")
    found = found.select(
        "doc_id", "h", "size", "source_size", "target", F.aggregate("parts", F.lit(0).cast("long"), lambda sum_, x: sum_ + x.words).alias("taken"),
        shown.alias("shards"), "first", "b0", "b1", "own",
    )
    none = F.lit(0).cast("long").alias("taken"), F.lit("").alias("shards")
    empty = placed.where("size = 0").select("doc_id", "h", "size", "source_size", "target", *none, "first", "b0", "b1", F.array().cast(found.schema["own"].dataType).alias("own"))
    return found.union(empty)


def mix(docs: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, shards."""
    return planned(docs, shard_blocks=shard_blocks).select("doc_id", "size", "source_size", "target", "taken", "shards")


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix itself: a document's c-th copy has the words of its blocks that are taken c times or more.

    They come in their order and with the white space before each; a copy that has all words is the text as it
    is.  Documents that take nothing go.  n_chars follows the text.
    """
    plan = planned(docs, block, shard_blocks=shard_blocks).where("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("plan_id"), F.col("h").alias("plan_h")).agg(F.min(F.struct("first", "b0", "b1", "own")).alias("p"))
    per_block = F.transform(
        F.sequence("p.b0", "p.b1"),
        lambda b: F.aggregate("p.own", F.lit(0).cast("long"), lambda n, s: n + F.when((b >= s.c0) & (b < s.c0 + s.n), times(s, b)).otherwise(0)),
    )
    plan = plan.select("plan_id", "plan_h", F.col("p.first").alias("first"), F.col("p.b0").alias("b0"), per_block.alias("per_block"))
    own = docs.select(*DOCUMENT_COLUMNS).withColumn("plan_h", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    found = own.join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col("plan_id")) & (own.plan_h == plan.plan_h))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("per_block"))))
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++)"), F.lit(1))
    at = lambda i: (F.floor((F.col("first") + i) / block) - F.col("b0")).cast("int")
    part = F.array_join(F.filter(words, lambda _, i: F.get("per_block", at(i)) >= F.col("copy")), "")
    part = F.regexp_replace(part, r"^[\x20\x09-\x0D]+", "")
    text = F.when(F.array_min("per_block") >= F.col("copy"), F.col("text")).otherwise(part)
    return found.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS) -> str:
    """The same in DuckDB's SQL.  Prefix sums need no slices there: the order within a source is the same."""
    return f"""
WITH docs AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(text, '')) AS h,
        cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS bigint) AS size,
        cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id AS varchar), '')), 1, 15) AS bigint) AS slot
    FROM documents
), sized AS (
    SELECT skey, cast(sum(size) AS bigint) AS source_size FROM docs GROUP BY skey
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY skey) - 1 AS rank, (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight,
        cast(sum(source_size) OVER () AS bigint) AS total FROM sized
), ratios AS (
    SELECT *, {MOST}.0::double * source_size / weight AS ratio FROM ranked
), levels AS (
    SELECT *, cast(total - coalesce(sum({MOST} * source_size) OVER before, 0) AS double)
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
    FROM ratios WINDOW before AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), wanted AS (
    SELECT skey, source_size, rank, total, (source_size + {block - 1}) // {block} AS blocks_of, least({MOST}.0::double * source_size,
        coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * weight, 0)) AS target FROM levels
), dealt AS (
    SELECT *, count(*) OVER () AS n_sources, unnest(range(1, greatest(1, (total // {block} + {shard_blocks - 1}) // {shard_blocks}) + 1)) AS shard FROM wanted
), bounds AS (
    SELECT *, least(total // {block}, shard * {shard_blocks}) AS awards, (SELECT count(*) FROM wanted) AS sources FROM dealt
), certain AS (
    SELECT *, CASE WHEN 2 * awards > sources
        THEN cast(greatest(0, floor((target * (2 * awards - sources) / total + 1) / 2) - 1) AS bigint) ELSE 0 END AS low,
        CASE WHEN total > 0 THEN cast(ceil((target * (2 * awards + sources) / total + 1) / 2) + 1 AS bigint) ELSE 0 END AS high
    FROM bounds
), opened AS (
    SELECT *, awards - sum(low) OVER (PARTITION BY shard) AS open FROM certain
), next_ones AS (
    SELECT skey, rank, shard, low, open, target, unnest(range(low, high + 1)) AS j FROM opened
), placed AS (
    SELECT skey, shard, low, open, target / (2 * j + 1) AS quotient,
        row_number() OVER (PARTITION BY shard ORDER BY target / (2 * j + 1) DESC, rank) AS place FROM next_ones
), awarded AS (
    SELECT skey, shard, cast(max(low) + sum(CASE WHEN place <= open AND quotient > 0 THEN 1 ELSE 0 END) AS bigint) AS so_far FROM placed GROUP BY skey, shard
), totals AS (
    SELECT skey, shard, so_far, blocks_of, max(so_far) OVER (PARTITION BY skey) AS most FROM awarded JOIN wanted USING (skey)
), ends AS (
    SELECT *, CASE WHEN most > 0 THEN cast((cast(blocks_of AS hugeint) * so_far + most - 1) // most AS bigint) ELSE 0 END AS upto FROM totals
), given AS (
    SELECT *, {MOST} * upto + least(0, min(so_far - {MOST} * upto) OVER (PARTITION BY skey ORDER BY shard)) AS gave FROM ends
), cuts AS (
    SELECT skey, shard, lag(upto, 1, 0) OVER own AS c0, upto - lag(upto, 1, 0) OVER own AS n, gave - lag(gave, 1, 0) OVER own AS quota
    FROM given WINDOW own AS (PARTITION BY skey ORDER BY shard)
), steps AS (
    SELECT *, quota // n AS rounds, quota % n AS extra, cast('0x' || substr(md5('{SEED}:' || skey || ':' || shard), 1, 15) AS bigint) % n AS start,
        CASE {' '.join(f'WHEN n % {p} <> 0 THEN {p}' for p in STEPS)} ELSE 1 END AS step FROM cuts WHERE n > 0
), spans AS (
    SELECT *, row_number() OVER () AS id, coalesce(sum(size) OVER (PARTITION BY skey ORDER BY slot, doc_id NULLS FIRST, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first
    FROM docs
), shares AS (
    SELECT id, shard, cast(list_sum([(least(first + size, (b + 1) * {block}) - greatest(first, b * {block}))
        * (rounds + CASE WHEN ((b - c0) * step + start) % n < extra THEN 1 ELSE 0 END)
        FOR b IN range(greatest(first // {block}, c0), least((first + size - 1) // {block}, c0 + n - 1) + 1)]) AS bigint) AS words
    FROM spans JOIN steps USING (skey) WHERE size > 0 AND c0 <= (first + size - 1) // {block} AND c0 + n > first // {block}
), joined AS (
    SELECT id, sum(words)::bigint AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS shards FROM shares WHERE words > 0 GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(shards, '') AS shards
FROM spans JOIN wanted USING (skey) LEFT JOIN joined USING (id)
"""


ORACLE_SQL = oracle()
