"""Operators that learn: accuracy on held-out rows, rules of learning, and odd rows."""

from __future__ import annotations

import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from grainmill.llm import blocks, langid, neighbours, quality
from grainmill.llm.common import held_out

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


def test_held_out_rows(spark):
    rows = spark.createDataFrame([(i,) for i in range(-5, 60)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in rows.select("doc_id", held_out(F.col("doc_id"))).collect()}
    assert all(v == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, v in got.items())


def test_languages(docs):
    got = langid.identify(docs, fit_rows=150).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def plain_grams(text):
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        for n in (3, 4):
            yield from (f" {word} "[i : i + n] for i in range(len(word) + 3 - n))


def test_predictions_equal_those_of_exact_sets(docs):
    rows = docs.collect()
    learned = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    sizes = Counter(r.lang for r in learned)
    counts = {k: Counter() for k in sizes}
    for r in learned:
        counts[r.lang].update(set(plain_grams(r.text)))
    most: dict = {}
    for k, own in counts.items():
        for g, n in own.items():
            most[g] = max(most.get(g, 0), n / sizes[k])
    sets = {k: {g for g, n in own.items() if n / sizes[k] >= langid.OWN * most[g]} for k, own in counts.items()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, fit_rows=10**6, fit_grams=10**6).collect()}
    same = near = 0
    for r in rows:
        grams = list(plain_grams(r.text or ""))
        by = sorted(((sum(g in own for g in grams), k) for k, own in sets.items()), reverse=True)
        if not any(map(str.isalpha, r.text or "")):
            assert got[r.doc_id] == ("und", 0.0)
            same, near = same + 1, near + 1
            continue
        same += got[r.doc_id][0] == by[0][1]
        near += abs(got[r.doc_id][1] - by[0][0] / max(1, by[0][0] + by[1][0])) < 0.03
    assert same >= 0.995 * len(rows) and near >= 0.97 * len(rows)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Wörter und noch mehr Wörter, 12 davon ΟΔΟΣ don't " * 40
    whole = sorted(langid.grams_of(text).tolist())
    monkeypatch.setattr(langid, "PIECE", 7)
    assert sorted(np.concatenate([langid.grams_of(p) for p in langid.pieces_of(text)]).tolist()) == whole
    assert "".join(langid.pieces_of(text)) == text and len(list(langid.pieces_of("x" * 100))) == 1


def test_odd_languages(odd_docs, odd_rows, no_docs):
    got = langid.identify(odd_docs).collect()
    assert len(got) == len(odd_rows) and langid.identify(no_docs).count() == 0
    for r in got:
        if r.doc_id in (300, 301, 302, 304, 307):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in got} <= {"und", "en", "fr"}


def test_filter_returns_all_languages_of_a_gram():
    grams = [np.arange(i * 100, i * 100 + 150, dtype=np.uint64) * np.uint64(2654435761) for i in range(70)]
    names = [f"l{i:02d}" for i in range(70)]
    found = langid.Filter(names, grams)
    for i in (0, 8, 40, 69):
        counts = found.counts(grams[i])
        for k in range(70):
            truth = len(np.intersect1d(grams[i], grams[k]))
            assert truth <= counts[k] <= truth + 150 * found.chance[k] + 12


def test_quality(docs, labels):
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.95
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)


def test_scores_equal_sizes_computed_anew(docs, labels):
    scorer = quality.fit(docs, labels, fit_rows=200)
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels, fit_rows=200).collect()}
    for r in docs.collect():
        data = (r.text or "").encode()
        sizes = []
        for known in (scorer.good, scorer.bad):
            squeeze = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(known), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(squeeze.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
        x, short = 10 * (sizes[1] - sizes[0]) / (len(data) + 32), 32 / (len(data) + 32)
        z = scorer.weights[0] + scorer.weights[1] * x + scorer.weights[2] * short + scorer.weights[3] * x * short
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_scores_are_calibrated(docs, labels):
    rows = quality.quality_scores(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").collect()
    score, truth = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert np.mean((score - truth) ** 2) <= 0.05  # Brier
    assert abs(score.mean() - truth.mean()) <= 0.05
    for low, high in ((0, 0.5), (0.5, 1.01)):
        at = (score >= low) & (score < high)
        assert at.sum() < 10 or abs(score[at].mean() - truth[at].mean()) <= 0.1


def test_more_fitted_rows_change_little(docs, labels):
    few, many = (
        {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels, rows).collect()} for rows in (2000, 10**6)
    )
    assert np.mean([few[k] == many[k] for k in few]) >= 0.99


def test_quality_learns_nothing_from_held_out_rows(docs, labels):
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.fit(docs, own, fit_rows=100) for own in (labels, flipped))
    assert one.__getstate__() == two.__getstate__()


def test_odd_quality(spark, odd_docs, odd_rows, no_docs, labels):
    known = spark.createDataFrame([(i, i % 2, 0, "x", 1.0) for i in range(60)] * 2 + [(None, 1, 0, "x", 1.0), (7, None, 0, "x", 1.0)], "doc_id long, quality int, toxic int, text string, curve double")
    got = quality.quality_scores(odd_docs, known).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(no_docs, known).count() == 0
    assert {r.score for r in quality.quality_scores(odd_docs, labels.limit(0)).collect()} == {1.0}
    kept = quality.keep_good(odd_docs, labels.limit(0)).collect()
    assert len(kept) == len(odd_rows)


def test_quality_stage_keeps_what_it_predicts(docs, labels):
    scores = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == scores


def brute(rows, k):
    good = {i: np.array(v, float) for i, v in rows if v and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8}
    ids = np.array(sorted(good))
    table = np.array([good[i] for i in ids])
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((table - good[i]) ** 2).sum(1))
        d[ids == i] = np.inf
        near = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        yield int(i), [(int(ids[j]), d[j]) for j in near]


def test_neighbours(spark):
    draw = np.random.RandomState(1)
    rows = [(i, draw.randn(8).tolist()) for i in range(3000)]
    rows += [(4000 + i, rows[0][1]) for i in range(1500)]  # copies of a query: ties
    rows += [(9100, None), (9200, []), (9300, [0.0] * 8), (9400, [1.0] * 7 + [None]), (9500, [float("nan")] * 8), (9600, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, part int").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got: dict = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    expected = dict(brute(rows, 10))
    assert got.keys() == expected.keys()
    hits = 0
    for query, near in expected.items():
        own = [got[query][i + 1] for i in range(10)]
        assert own == sorted(own, key=lambda x: (x[1], x[0]))
        table = {i: v for i, v in rows if i is not None}
        for vec_id, score in own:
            assert score == pytest.approx(np.sqrt(((np.array(table[vec_id], float) - np.array(table[query], float)) ** 2).sum()), abs=1e-12)
        hits += len({i for i, _ in own} & {i for i, _ in near})
    assert hits >= 0.9 * 10 * len(expected)
    assert [v for v, _ in got[0].values()] == list(range(4000, 4010))  # ties go to smaller ids


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_ROWS", 40)
    monkeypatch.setattr(neighbours, "SAMPLED", 16)
    draw = np.random.RandomState(3)
    x = np.repeat(draw.randn(60, 8) * 6, 100, axis=0) + draw.randn(6000, 8)
    assert neighbours.fit(x[::4], 6000)[0].parts == 64  # as many as the sample allows
    assert neighbours.fit(x, 6000)[0].parts == 128
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for sample, block_bytes in ((500, 1 << 20), (10**6, 900)):  # blocks of fourteen rows
        got: dict = {}
        for r in neighbours.nearest(df, sample=sample, block_bytes=block_bytes).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        expected = dict(brute(list(enumerate(x.tolist())), 10))
        assert sum(len(set(got[q]) & {i for i, _ in near}) for q, near in expected.items()) >= 0.9 * 10 * len(expected)


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [5.0, 5.0]), (100, [1.0, 0.5])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_balanced_partition():
    x = np.random.RandomState(2).randn(1000, 6)
    part = neighbours.balanced(x, neighbours.graph_of(x, 10), 8)
    assert np.bincount(part, minlength=8).max() <= 1000 / 8 * 1.06


class Article(HTMLParser):
    """An independent reading: the blocks of the article elements, without what is marked as something else."""

    VOID, INLINE = {"br", "img", "input", "meta", "link", "hr"}, {"a", "b", "i", "em", "strong", "span", "code", "u"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.blocks, self.parts = 0, 0, [], []

    def cut(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in self.VOID:
            return
        self.depth += tag == "article"
        self.skip += tag in ("script", "style")
        if tag not in self.INLINE:
            self.cut()

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.cut()
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if self.depth > 0 and not self.skip:
            self.parts.append(data)


def test_pages(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = {r.page_id: r for r in blocks.main_texts(pages).collect()}
    right = 0
    for r in pages.collect():
        plain = Article()
        plain.feed(r.html)
        plain.close()
        plain.cut()
        right += got[r.page_id].text == "\n\n".join(plain.blocks)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert len(got) == pages.count() and right >= 0.98 * len(got)


def test_reading_is_linear_in_the_page():
    for page, most in (("<div>x " * 200_000, 20), ("<a " * 340_000, 5), ("<!x" * 300_000, 5), ("<a '" * 250_001 + ">", 5), ("<p>y<b>" * 100_000, 20), ("<ul><li>z" * 100_000, 20)):
        began = time.perf_counter()
        found = blocks.blocks_of(page)
        assert time.perf_counter() - began < most, page[:8]
        assert "'" in page or sum(len(b.text) for b in found) >= 100_000  # without quotes that close, all is one tag
    deep = blocks.blocks_of("<div class=a>x " * 50_000)
    assert deep[-1].depth == 50_000 and blocks.vectors_of(deep[-5:]).max() < 20


def test_long_pages_are_labelled_in_pieces():
    page = blocks.blocks_of("<nav><ul><li><a href=x>Home</a></ul></nav><article>" + "<p>Some words in a row, and some more of them here.</p>" * 300 + "</article><footer>© 2024</footer>")
    assert blocks.labeller().label_long(page, 7) == blocks.labeller().label([page])[0]


def test_odd_pages(spark):
    long = "<article>" + "<p>Some words in a row, and some more of them here.</p>" * 5000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "no tags at all"), (4, "u", "<<<>><p"), (5, "u", long), (None, "u", "<p>x"), (5, "u", long), (6, "u", "<script>var a = '<p>no</p>'</script><!-- x")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = blocks.main_texts(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == by[6].text == ""
    assert by[5].text.count("\n\n") == 4999
    assert blocks.main_texts(df.limit(0)).count() == 0


def test_made_pages_held_out():
    wrong = total = 0
    for x, y in blocks.training(60, seed=5):
        scores = blocks.labeller().scores(*blocks.padded([x]))[:, 0]
        wrong += int(((scores > 0) != (y > 0)).sum())
        total += len(y)
    assert wrong <= 0.03 * total


def test_slopes():
    draw = np.random.RandomState(0)
    net = blocks.Labeller(1)
    x = draw.randn(4, 3, blocks.SIZE).astype(np.float32)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], np.float32)
    y = (draw.rand(4, 3) > 0.5).astype(np.float32)

    def loss():
        p = 1 / (1 + np.exp(-net.scores(x, mask).astype(float)))
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    slopes = net.slopes(x, mask, y)
    for k, at in (("fx", (3, 5)), ("bh", (2, 40)), ("fc", (50,)), ("o", (7,)), ("bx", (9, 60))):
        was = net.w[k][at]
        net.w[k][at] = was + 1e-2
        up = loss()
        net.w[k][at] = was - 1e-2
        down = loss()
        net.w[k][at] = was
        assert slopes[k][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a&amp;b &lt;c&gt; d</p>", ["a&b <c> d"]), ("<p>a<br>b<p>c", ["a b", "c"]), ("<div>x<p>y</p>z</div>", ["x", "y", "z"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <svg><g><text>y</text></g></svg> ends</p>", ["so x=2 y ends"]),
        ("<head><title>t</title><p>b<p>c", ["b", "c"]), ("<head><meta x>text<div>d", ["text", "d"]), ("<p title='a>b", ["b"]), ("a<b", ["a<b"]),
        ("<p>a <b>b</b>c</p>", ["a bc"]), ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]), ("x < y <p a='>'>z", ["x < y", "z"]),
        ("<head><title>t</title><style>p{}</style></head><body>b", ["b"]), ("<p>a\n\t b</p><!-- c --><p>d</p>", ["a b", "d"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in blocks.blocks_of(page)] == texts


def test_all_words_of_a_block_are_hashed():
    long = "word " * 200
    one, other = blocks.vectors_of([blocks.Block(long + end, 1, 0, "p", 1, 0.0) for end in ("alpha beta gamma", "xylem delta stone")])
    words = slice(2 * blocks.TAGS + blocks.MARKS, -blocks.MEASURES)
    assert not np.allclose(one[words], other[words]) and one[words].sum() == pytest.approx(1, abs=1e-4)
