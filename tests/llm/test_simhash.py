"""Fingerprints, Golay keys, links and components against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from grainmill.llm import common, simhash


def plain_print(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, ids):
    above = list(range(len(prints)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                above[root(i)] = root(j)
    least: dict = {}
    for i, doc_id in enumerate(ids):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return [least.get(root(i)) for i in range(len(prints))]


def test_rows(spark, odd_docs, odd_rows, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows) and simhash.near_duplicates(no_docs).count() == 0
    prints = [plain_print(r[1]) for r in odd_rows]
    groups = plain_groups(prints, [r[0] for r in odd_rows])
    expected = sorted(repr((r[0], f"{p:016x}", g)) for r, p, g in zip(odd_rows, prints, groups, strict=True))
    assert sorted(repr(tuple(r)) for r in got) == expected


def test_golay_code_is_perfect_and_keys_meet():
    golay = simhash.Golay()
    assert (golay.leader != 0).sum() == 2047 and golay.far.sum() == 1771 and (golay.fours[golay.far] != 0).all()
    draw = np.random.RandomState(0)
    words = draw.randint(0, 1 << 23, 4000)
    nearest, five, far = golay.near(words)
    other, _, _ = golay.near(words ^ (1 << draw.randint(0, 23, 4000)))
    assert ((other == nearest) | ((five == other[:, None]) & far[:, None]).any(1)).all()


def near_prints(n, seed):
    draw = random.Random(seed)
    found = {draw.getrandbits(64) for _ in range(n)} | {0}
    for p in list(found):
        for _ in range(3):
            for _ in range(draw.randint(1, 3)):
                p ^= 1 << draw.randrange(64)
            found.add(p)
    return sorted(found)


def test_no_link_is_lost(spark):
    prints = near_prints(250, 4)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(3)
    expected = plain_groups(prints, signed)
    for hold, sample in ((simhash.HOLD, simhash.SAMPLE), (2, 1), (2, 7)):  # keys of more than two rows are dealt over blocks
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, hold=hold, sample=sample)).collect()}
        assert [roots.get(s, s) for s in signed] == expected


def test_one_key_with_very_many_rows(spark):
    draw = random.Random(5)
    prints = sorted({(draw.getrandbits(22) << 42) for _ in range(6000)})  # two whole segments in common
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(s,) for s in signed], "fp long").repartition(2)
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, hold=500, sample=4)).collect()}
    assert [roots.get(s, s) for s in signed] == plain_groups(prints, signed)


def test_chains_longer_than_sixty_rounds_and_hot_nodes_end(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_LEAST", 3)  # salts for every node with more than a few edges
    draw = random.Random(6)
    names = list(range(3000))
    draw.shuffle(names)
    edges = list(zip(names, names[1:], strict=False)) + [(5000, i) for i in range(5001, 5400)] + [(6400 - i, 6400) for i in range(1, 300)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 3000)) and all(got[i] == 5000 for i in range(5001, 5400)) and all(got[i] == 6101 for i in range(6102, 6401))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1300)] + [(-5, 7), (3, 3)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[i] == -5 for i in [7, *range(1000, 1300)])
    assert 3 not in got and -5 not in got


def test_few_links_are_joined_without_rounds(spark, odd_docs, monkeypatch):
    written = []
    plain_cut = simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df, name: written.append(name) or plain_cut(df, name))
    draw = random.Random(10)
    edges = [(draw.randint(-300, 300), draw.randint(-300, 300)) for _ in range(250)]
    edges += [(i, i + 1) for i in range(1000, 1080)] + [(9000, i) for i in range(5000, 5100)] + [(2**62, -(2**62)), (4, 4)]
    df = spark.createDataFrame(edges, "a long, b long")
    few = sorted(simhash.components(df, few=len(edges)).collect())
    assert written == ["edges"]
    assert few == sorted(simhash.components(df).collect()) and "stars" in written
    assert sorted(simhash.components(df, few=100).collect()) == few  # more than few: by rounds
    assert simhash.components(df.where("a = b"), few=100).count() == 0
    written.clear()
    kept = Counter(simhash.keep_one(odd_docs).collect())
    assert "stars" not in written
    assert Counter(simhash.keep_one(odd_docs, edges_most=0).collect()) == kept and "stars" in written


def test_hot_keys_start_no_rows_of_python(spark, monkeypatch):
    many = spark.range(2000).select(F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    one = many.groupBy("k").agg(F.min("id").alias("least"))
    expected = Counter(many.join(one, "k").collect())

    def never(*_, **__):
        raise AssertionError("rows of Python")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", never)
    assert Counter(common.spread_join(many, one, "k", 2000).collect()) == expected
    assert common.spread_join(many.where("id >= 1500"), one, "k", 2000).count() == 500  # no hot key


def test_one_of_each_group_stays(spark, odd_docs, odd_rows, no_docs):
    kept = simhash.keep_one(odd_docs).collect()
    assert Counter(simhash.keep_one(odd_docs, ends_most=0).collect()) == Counter(kept)  # texts picked by a shuffle
    prints = [plain_print(r[1]) for r in odd_rows]
    assert simhash.keep_one(no_docs).count() == 0
    groups = plain_groups(prints, list(range(len(prints))))
    by_print = dict(zip(prints, groups, strict=True))
    own = [by_print[plain_print(r.text)] for r in kept]
    assert sorted(own) == sorted(set(groups))
    assert {r.doc_id for r in kept} >= {100 if 100 in {x[0] for x in odd_rows} else None}


def plain_set(text):
    own = text.lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def test_sets_link_exactly_from_the_similarity_on(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(60):
        n = draw.randint(40, 300)
        base = [word() for _ in range(n)]
        texts.append(base)
        k = int(n * draw.uniform(0.02, 0.3))
        texts.append(base + [word() for _ in range(k)])  # an appended passage
        texts.append(base[: n - k] + [word() for _ in range(k)])  # a replaced one
        scattered = list(base)
        for at in draw.sample(range(n), max(1, n // draw.randint(12, 60))):
            scattered[at] = word()
        texts.append(scattered)
    texts = [" ".join(t) for t in texts]
    sets = [plain_set(t) for t in texts]
    above = list(range(len(texts)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                above[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in simhash.keep_one(df.repartition(3)).collect())
    assert kept == [i for i in range(len(texts)) if root(i) == i]
    own = df.select(F.col("doc_id").alias("node"), "text").repartition(3)  # keys of more than two rows are dealt over blocks
    roots = {r.node: r.root for r in simhash.components(simhash.set_links(own, 5, 0.8, hold=2, ends_most=0)).collect()}
    assert [roots.get(i, i) for i in range(len(texts))] == [root(i) for i in range(len(texts))]


def test_links_of_fingerprints_are_verified(spark):
    base = ["".join(random.Random(i).choice("abcdefgh") for _ in range(6)) for i in range(400)]
    texts = [base, [*base[:-1], "last"], [*base[:200], *reversed(base[200:])]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "node long, text string")
    prints = spark.createDataFrame([(i, simhash.set_print(simhash.shingles(" ".join(t), 5))) for i, t in enumerate(texts)], "node long, fp long")
    assert {(r.a, r.b) for r in simhash.print_pairs(prints).collect()} <= {(1, 0), (0, 1)}
    assert {frozenset(r) for r in simhash.set_links(df, 5, 0.8).collect()} == {frozenset((0, 1))}
    same = spark.createDataFrame([(i, 7) for i in range(5)] + [(9, 15)], "node long, fp long")
    assert {frozenset(r) for r in simhash.print_pairs(same).collect()} == {frozenset(x) for x in ((0, 1), (0, 2), (0, 3), (0, 4), (9, 0))}


def test_first_keys_of_similar_sets_meet():
    draw = np.random.RandomState(6)
    for _ in range(2000):
        n = draw.randint(1, 60)
        a = np.unique(draw.randint(0, 400, n).astype(np.uint64))
        b = np.unique(np.r_[a[draw.rand(len(a)) < 0.9], draw.randint(0, 400, draw.randint(0, 6)).astype(np.uint64)])
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            none, half = np.empty(0, np.uint64), np.arange(0, 200, dtype=np.uint64)
            for common in ((none, np.empty(0, np.int64)), (half, (half * 7 % 5).astype(np.int64))):
                assert len(np.intersect1d(simhash.first_keys(a, 0.8, common), simhash.first_keys(b, 0.8, common)))


def test_texts_below_the_similarity_stay(spark):
    draw = random.Random(9)
    rows = []
    for i in range(0, 60, 2):
        base = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
        other = list(base)
        for at in range(10, 300, 30):  # ten edits change 50 of 296 shingles: a similarity of 0.71
            other[at] += "x"
        rows += [(i, " ".join(base), "en", "a", 1), (i + 1, " ".join(other), "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert simhash.keep_one(df).count() == 60
