"""Mixing against a plain computation: sizes, targets, quotients one by one."""

from __future__ import annotations

import heapq
import re
from fractions import Fraction

import pytest

from grainmill.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Targets by sharing again and again."""
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(names)}
    total, fixed, free = sum(sizes.values()), {}, set(names)
    while free:
        left, share = total - sum(fixed.values()), sum(weight[k] for k in free)
        over = {k for k in free if Fraction(left * weight[k], share) > 3 * sizes[k]}
        if not over:
            return {k: fixed.get(k, Fraction(left * weight[k], share)) for k in names}
        fixed |= {k: Fraction(3 * sizes[k]) for k in over}
        free -= over
    return fixed


def test_rows(spark, odd_docs, odd_rows, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == len(odd_rows) and mixing.mix(no_docs).count() == 0
    sizes: dict = {}
    for _, text, _, source, _ in odd_rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    expected = sorted(repr((r[0], words(r[1]), sizes[r[3]], round(float(plain_targets(sizes)[r[3]]), 6))) for r in odd_rows)
    assert sorted(repr((r.doc_id, r["size"], r.source_size, round(r.target, 6))) for r in got) == expected
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken: dict = {}
    for r in got:
        taken[r.source_size, round(r.target, 3)] = taken.get((r.source_size, round(r.target, 3)), 0) + r.taken
    assert all(abs(t - target) <= 3 * mixing.BLOCK for (_, target), t in taken.items())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(odd_docs.repartition(1)).collect()))


@pytest.mark.parametrize("shard", [1, 7, 1000])
def test_quotas_are_the_highest_quotients(spark, shard):
    wanted = [("0a", 40, 0, 1000, 100.0), ("0b", 400, 1, 1000, 300.0), ("0c", 500, 2, 1000, 590.0), ("0d", 60, 3, 1000, 10.0), ("1", 0, 4, 1000, 0.0)]
    df = spark.createDataFrame([(*w, len(wanted)) for w in wanted], "skey string, source_size long, rank int, total long, target double, n_sources long")
    got: dict = {}
    for r in mixing.quotas(df, block=10, shard_blocks=shard).collect():
        got.setdefault(r.shard, {})[r.skey] = r.quota
    heap = [(-w[4], w[2], w[0], 0) for w in wanted if w[4] > 0]
    heapq.heapify(heap)
    expected: dict = {}
    for award in range(100):
        _, rank, skey, j = heapq.heappop(heap)
        target = next(w[4] for w in wanted if w[0] == skey)
        heapq.heappush(heap, (-target / (2 * j + 3), rank, skey, j + 1))
        own = expected.setdefault(award // shard + 1, {})
        own[skey] = own.get(skey, 0) + 1
    assert {s: {k: v for k, v in q.items() if v} for s, q in got.items()} == expected


def test_walk_selects_as_many_blocks_as_the_quota_says(spark):
    n, step = 1009, mixing.STEPS[0]
    assert sorted(b * step % n for b in range(n)) == list(range(n))
    assert all(all(p % d for d in range(2, 9200)) for p in mixing.STEPS)


def shard_words(rows):
    found: dict = {}
    for r in rows:
        for part in filter(None, r.shards.split(",")):
            shard, words_ = map(int, part.split(":"))
            found[r.source_size, shard] = found.get((r.source_size, shard), 0) + words_
    return found


@pytest.mark.parametrize("shard", [3, 40, 500])
def test_each_shard_takes_its_own_quota(spark, odd_docs, shard):
    sizes = mixing.planned(odd_docs, shard_blocks=shard).cache()
    rows = sizes.collect()
    wanted = mixing.targets(sizes.select("source_size").distinct().selectExpr("concat('0', lpad(source_size, 12, '0')) as skey", "source_size"))
    assert wanted.count() == len({r.source_size for r in rows})
    per: dict = {}
    for r in rows:
        assert r.taken == sum(int(x.split(":")[1]) for x in r.shards.split(",") if x)
        for s in r.own:
            per.setdefault((r.source_size, s.shard), s)
    took = shard_words(rows)
    for (source, number), s in per.items():
        quota = s.rounds * s.n + s.extra
        last = s.c0 + s.n == -(-source // mixing.BLOCK)  # the source's last block is not full
        assert 0 <= quota * mixing.BLOCK - took.get((source, number), 0) <= (3 * mixing.BLOCK if last else 0)
        assert s.rounds + (s.extra > 0) <= 3
    for source in {r.source_size for r in rows if r.source_size}:
        taken, target = sum(r.taken for r in rows if r.source_size == source), next(r.target for r in rows if r.source_size == source)
        assert abs(taken - target) <= 5 * mixing.BLOCK, (source, taken, target)


@pytest.mark.parametrize("shard", [7, 300, mixing.SHARD_BLOCKS])
def test_duckdb_agrees(spark, odd_docs, shard):
    import duckdb

    for docs in (odd_docs.select("doc_id", "text", "source"), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        documents = docs.toPandas()  # noqa: F841
        documents["doc_id"] = documents["doc_id"].astype("Int64")
        expected = duckdb.sql(mixing.oracle(shard_blocks=shard)).fetchall()
        got = mixing.mix(docs, shard).collect()
        assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, expected))


def test_walks_never_leave_64_bits(spark):
    awarded = [("0a", k, 10**13, k * 65_536) for k in range(1, 4)] + [("0b", k, 10**12 * k, k) for k in range(1, 4)]
    found = mixing.shards_of(spark.createDataFrame([(a, k, 10**13, q) for a, k, _, q in awarded], "skey string, shard long, source_size long, so_far long")).collect()
    assert {r.skey for r in found} == {"0a", "0b"} and all((r.n - 1) * r.step + r.start < 2**63 for r in found)
    assert all(sum(r.n for r in found if r.skey == k) == -(-(10**13) // mixing.BLOCK) for k in ("0a", "0b"))


def test_mixed_documents(spark, odd_docs, no_docs):
    plan = [r for r in mixing.planned(odd_docs).collect() if r.taken]
    got = mixing.mixed_documents(odd_docs).collect()
    assert mixing.mixed_documents(no_docs).count() == 0
    taken: dict = {}
    for r in plan:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    shown: dict = {}
    for r in got:
        shown[r.doc_id] = shown.get(r.doc_id, 0) + words(r.text)
        assert r.n_chars == len(r.text)
    assert {k for k in shown} == {k for k in taken}
    assert all(shown[k] == taken[k] for k in taken if k not in (5, None))  # repeated rows share a plan


def test_the_words_of_selected_blocks_come(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(9999)), "en", "a", 1), (2, "x " * 10_000, "en", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for shard in (7, mixing.SHARD_BLOCKS):
        plan = {r.doc_id: r for r in mixing.planned(df, shard_blocks=shard).collect()}
        got = [r.text for r in mixing.mixed_documents(df, shard_blocks=shard).collect() if r.doc_id == 1]
        assert len(got) == 1 and len(plan[1].own) == len({s.shard for s in plan[1].own})  # weights 1 and 2: about two thirds of the first
        at = [int(w[1:]) for w in got[0].split(" ")]
        assert len(at) == plan[1].taken < 9999 and at == sorted(at)
        taken = {b for s in plan[1].own for b in range(s.c0, s.c0 + s.n) if ((b - s.c0) * s.step + s.start) % s.n < s.extra}
        assert at == [i for i in range(9999) if i // mixing.BLOCK in taken] and max(at) > plan[1].taken


def test_copies_of_blocks_add_up(spark, odd_docs):
    plan = [r for r in mixing.planned(odd_docs, shard_blocks=5).collect() if r.taken]
    shown: dict = {}
    for r in mixing.mixed_documents(odd_docs, shard_blocks=5).collect():
        shown[r.doc_id] = shown.get(r.doc_id, 0) + words(r.text)
    assert all(shown[r.doc_id] == r.taken for r in plan if r.doc_id not in (5, None))
