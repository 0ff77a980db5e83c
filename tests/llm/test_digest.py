"""Digests and neighbours against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.llm import digest
from grainmill.llm.common import Ranges


def test_rows(spark, odd_docs, odd_rows, no_docs):
    got = digest.quartile_digests(odd_docs, part_bytes=20_000).collect()
    assert len(got) == len(odd_rows) and digest.quartile_digests(no_docs).count() == 0
    distinct = [r for r in odd_rows if r[0] is not None and Counter(x[0] for x in odd_rows)[r[0]] == 1]
    order = sorted((r for r in odd_rows if r[0] is not None), key=lambda r: -r[0])
    by = {r.doc_id: r for r in got}
    for doc_id, text, *_ in distinct:
        i = [r[0] for r in order].index(doc_id)
        if i + 1 == len(order) or Counter(x[0] for x in odd_rows)[order[i + 1][0]] > 1:
            continue
        text, following = text or "", order[i + 1][1] or ""
        changed = digest.edited(text, following)
        row = by[doc_id]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (row.fingerprint, row.edited_fingerprint) == (digest.digest(text), digest.digest(changed))
        assert row.near_edited == digest.likeness(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == digest.likeness(row.fingerprint, digest.digest(following))


@pytest.mark.parametrize("part_bytes", [1, 300, 10**9])
def test_last_meets_first(spark, part_bytes):
    rows = [(i * i, f"text {i} " * (i + 1)) for i in range(30)]
    got = {r.doc_id: r for r in digest.quartile_digests(spark.createDataFrame(rows, "doc_id long, text string"), part_bytes).collect()}
    texts = [t for _, t in sorted(rows, reverse=True)]
    for i, (doc_id, text) in enumerate(sorted(rows, reverse=True)):
        changed = digest.edited(text, texts[(i + 1) % 30])
        assert got[doc_id].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()


@pytest.mark.parametrize("columns", ["doc_id long, text string", "doc_id long, text string, part int, h long, at int"])
def test_ties_do_not_depend_on_the_parts(spark, columns):
    rows = [(i // 3 if i % 7 else None, f"text {i % 40} " * (i % 5 + 1)) for i in range(60)] + [(7, "the same text")] * 5
    df = spark.createDataFrame([(*r, 1, 2, 3)[: columns.count(",") + 1] for r in rows], columns)
    hashes = {r.text: r.k for r in df.select("text", F.xxhash64("text").alias("k")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    edits = [digest.edited(t, order[(i + 1) % len(order)][1]) for i, (_, t) in enumerate(order)]
    expected = sorted(repr((r[0], digest.digest(r[1]), hashlib.sha256(e.encode()).hexdigest())) for r, e in zip(order, edits, strict=True))
    for part_bytes, n in ((1, 4), (200, 1), (900, 3), (10**9, 2)):
        got = digest.quartile_digests(df.repartition(n), part_bytes).collect()
        assert sorted(repr((r.doc_id, r.fingerprint, r.edited_sha256)) for r in got) == expected


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "".join(chr(97 + i * i % 23) for i in range(5000)) + "é漢"
    whole = digest.digest(text)
    for piece in (1, 2, 3, 999, 5004):
        monkeypatch.setattr(digest, "PIECE", piece)
        assert digest.digest(text) == whole


def test_parts_stay_near_their_goal(spark):
    draw = random.Random(7)
    sets = {
        "outlier": [(i, i) for i in range(20_000)] + [(2**62, 1), (-(2**63), 2), (2**63 - 1, 3)],
        "clusters": [(c * 2**40 + draw.randrange(50), draw.getrandbits(63) - 2**62) for c in range(90) for _ in range(200)],
        "one id": [(5, draw.getrandbits(64) - 2**63) for _ in range(9000)] + [(None, draw.getrandbits(64) - 2**63) for _ in range(9000)],
    }
    for name, rows in sets.items():
        df = spark.createDataFrame(rows, "k long, t long").withColumn("w", F.lit(1))
        ranges = Ranges(df, "k", "t", "w", 400, bins=128)
        got = ranges.with_part(df).collect()
        sizes = Counter(r.part for r in got)
        assert max(sizes.values()) < 2 * 400 and min(sizes) == 0 and max(sizes) == ranges.parts - 1, name
        ordered = sorted(got, key=lambda r: (r.k is not None, r.k or 0, r.t >> 1))
        assert [r.part for r in ordered] == sorted(r.part for r in got), name
    none = spark.createDataFrame([], "k long, t long, w int")
    assert Ranges(none, "k", "t", "w", 10).with_part(none).count() == 0
    same = spark.createDataFrame([(1, 1, 1)] * 50, "k long, t long, w int")  # rows that nothing tells apart stay together
    assert {r.part for r in Ranges(same, "k", "t", "w", 10).with_part(same).collect()} == {0}


def test_one_row(spark):
    row = digest.quartile_digests(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0


def test_counts_by_hand():
    data, counts = "abcdeabc".encode(), Counter()
    m = digest.MIX
    for i in range(len(data) - 2):
        counts[int(m[0][data[i]] ^ m[1][data[i + 1]] ^ m[2][data[i + 2]])] += 1
    for i in range(len(data) - 3):
        counts[int(m[0][data[i]] ^ m[1][data[i + 1]] ^ m[3][data[i + 3]])] += 1
        counts[int(m[0][data[i]] ^ m[4][data[i + 2]] ^ m[3][data[i + 3]])] += 1
    ordered = sorted(counts[b] for b in range(256))
    quarter = [ordered[63], ordered[127], ordered[191]]
    codes = [sum(counts[b] > q for q in quarter) for b in range(256)]
    packed = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 256, 4))
    assert digest.digest("abcdeabc")[2:] == packed.hex()


def test_likeness_is_bounded_and_ordered():
    one, other = "the quick brown fox jumps over the lazy dog " * 20, "0123 9876 5555 zzzz qqqq " * 40
    near = one[:700] + "a small change at the end of it"
    a, b, c = map(digest.digest, (one, near, other))
    assert digest.likeness(a, a) == 1.0 and 0 <= digest.likeness(a, c) < digest.likeness(a, b) < 1
    assert digest.difference(a, c) == digest.difference(c, a) <= 6 * 256 + digest.LENGTH_MOST
