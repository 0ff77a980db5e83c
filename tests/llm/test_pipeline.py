"""Stages one by one against plain versions, and as a whole."""

from __future__ import annotations

import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from grainmill.llm import bpe, mixing, quality, secrets
from grainmill.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "tokens"]
    assert sorted(int(q[2:].split("_")[0]) for q in queries()) == list(range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").cache()
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality"](spark, docs, FOLDER)
    assert good.columns == COLUMNS
    scorer = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect() if scorer.score(r.text) >= quality.GOOD}
    good = good.cache()
    one = steps["near_duplicates"](spark, good, FOLDER)
    assert one.columns == COLUMNS
    rows = good.collect()
    kept = {r.doc_id for r in one.collect()}
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (r.text.lower().split() for r in rows)]
    for i, r in enumerate(rows):
        alike = [j for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
        assert not any(r.doc_id in kept and rows[j].doc_id in kept for j in alike)
        if r.doc_id not in kept:  # something of that similarity was there
            assert any(len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]) for j in range(len(rows)) if j != i)
    one = one.cache()
    clean = steps["secrets"](spark, one, FOLDER)
    assert clean.columns == COLUMNS and clean.count() == one.count()
    assert not any(secrets.scan(r.text) for r in clean.collect())
    mixed = steps["mix"](spark, clean.cache(), FOLDER)
    assert mixed.columns == COLUMNS
    taken = mixing.mix(clean).groupBy().sum("taken").first()[0]
    assert sum(len(r.text.split()) for r in mixed.collect()) == taken


def test_run(spark):
    library = Tokenizer.from_file(bpe.VOCABULARY)
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert got and all(r.n_tokens > 0 for r in got)
    again = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    whole = [r for r in got if library.encode(docs[r.doc_id], add_special_tokens=False).ids and np.isclose(r.n_tokens, len(library.encode(docs[r.doc_id], add_special_tokens=False).ids))]
    assert whole  # documents taken whole keep all their tokens


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    steps = dict(corpus_pipeline.STAGES)
    got = {name: stage(spark, odd_docs, FOLDER) for name, stage in steps.items()}
    for name, stage in steps.items():
        assert stage(spark, no_docs, FOLDER).count() == 0
        assert name == "tokens" or got[name].columns == COLUMNS
    rows = sorted(map(repr, odd_rows))
    good = [repr(tuple(r)) for r in got["quality"].collect()]
    assert set(good) <= set(rows) and all(good.count(r) == rows.count(r) for r in set(good))  # repeated rows alike
    kept = got["near_duplicates"].collect()
    ids = [r.doc_id for r in kept]
    assert ids.count(5) == 2 and ids.count(300) == 1 and 301 not in ids and 304 not in ids  # two texts of one id; null and empty texts
    assert 100 in ids and not set(ids) & {*range(101, 140), *range(200, 240)}  # copies, exact and near ones
    assert ids.count(None) == 1 and {305, 306} <= set(ids)  # a text that only a row without id has; long ones
    clean = got["secrets"].collect()
    assert len(clean) == len(odd_rows) and sum(r.text is None for r in clean) == sum(r[1] is None for r in odd_rows)
    mixed = got["mix"].collect()
    assert not any(r.text is None or not r.text.strip() for r in mixed) and all(r.n_chars == len(r.text) for r in mixed)
    encoded = got["tokens"].collect()
    assert len(encoded) == len(odd_rows) and all((r.n_tokens == 0) == (r.ids_sha256 == hashlib.sha256(b"").hexdigest()) for r in encoded)
