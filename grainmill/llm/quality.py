"""Quality by compression: zstandard dictionaries of good and of bad text.

One dictionary is built from blocks of text labelled good and one from blocks labelled
bad.  A text is compressed block by block with either; the difference of the compressed
sizes over the text's size says which it resembles, and a logistic curve fitted on other
labelled rows turns it into a probability.  Blocks of one size keep the dictionaries'
share alike in short and long texts.  Lines that recur among the sampled documents
(licences, boilerplate) say nothing of quality and stay out of the dictionaries.

Fitting takes a sample bounded by ``fit_rows`` documents of each label and
``fit_blocks`` blocks of each of these (by hash of doc_id, so that reruns agree); every
document is scored over its whole text.

Defined cases: null text counts as empty; an empty text gets the score of no evidence
either way; texts of any length are compressed block by block.  A document with several labels
(repeated rows of labels too) counts as bad if one of them is.  Where labels of one kind are
missing, every score is the smoothed share of good labels (1 where there are none at all).  Rows
with equal doc_id, and repeated rows, are scored each on its own (of texts that share a labelled
id the least is learned from); an empty table gives an empty result; other columns of documents
and of labels, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import DOCUMENT_COLUMNS, held_out, map_rows

QUERY = "op5_quality_compression"
ORACLE_SQL = None

#: Bytes of a block, of a dictionary, and the compression level.
BLOCK, DICTIONARY, LEVEL = 1024, 112 << 10, 3
#: Score from which a document counts as good.
GOOD = 0.7


def blocks_of(text: str) -> list[bytes]:
    """A text's bytes in blocks."""
    data = text.encode("utf-8", "replace")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


class Scorer:
    """Both dictionaries and the fitted curve; pickles as plain bytes and numbers."""

    def __init__(self, good: bytes, bad: bytes, weights: list[float] | None = None, share: float | None = None) -> None:
        self.good, self.bad, self.weights, self.share = good, bad, weights, share
        self._pair = None

    def __getstate__(self) -> tuple:
        return self.good, self.bad, self.weights, self.share

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Normalised difference of compressed sizes, shortness of the text, and their product."""
        if self._pair is None:
            self._pair = []
            for data in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(data)
                known.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_dict_id=False))
        parts = blocks_of(text or "")
        good, bad = (sum(len(c.compress(b)) for b in parts) for c in self._pair)
        size = sum(map(len, parts))
        x, short = 10 * (bad - good) / (size + 32), 32 / (size + 32)
        return x, short, x * short

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        if self.share is not None:
            return self.share
        z = float(np.dot(self.weights, (1.0, *self.features(text))))
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of few samples, their plain bytes."""
    if len(samples) >= 64:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # too alike or too short to train on
    return b"".join(samples)[-DICTIONARY:] or b"\n"


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Weights (constant first) of a logistic curve, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * len(x) * np.r_[0, w[1:]] / 100
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) / 100 * np.eye(len(w)) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 2000, fit_blocks: int = 4) -> Scorer:
    """Dictionaries and curve from labelled documents that are not held out.

    Of each label about ``fit_rows`` documents are taken at most, half of them for the
    dictionaries (``fit_blocks`` blocks each reach the driver) and half for the curve
    (three numbers each reach the driver).
    """
    known = (
        labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    )
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return Scorer(b"\n", b"\n", share=(good + 1) / (good + bad + 1))
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    rate = F.when(F.col("quality") == 1, F.lit(min(1.0, fit_rows / good))).otherwise(F.lit(min(1.0, fit_rows / bad)))
    some = known.where(draw < rate * (1 << 30)).withColumn("curve", F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(2)) == 1)
    own = (  # about 2 * fit_rows ids: bounded, so broadcast
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(some), "doc_id").where("text is not null")
        .groupBy("doc_id", "quality", "curve").agg(F.min("text").alias("text"))
    )

    def sampled(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, quality, text in rows:
            lines = text.split("\n")
            at = np.random.RandomState(doc_id & 0x7FFFFFFF).permutation(max(1, len(text) // BLOCK))[:fit_blocks]
            for i in sorted(at.tolist()):
                part = "\n".join(lines) if len(text) <= BLOCK else text[i * BLOCK : (i + 1) * BLOCK]
                yield doc_id, i, quality, part

    parts = map_rows(
        own.where("not curve").select("doc_id", "quality", "text"), sampled, "doc_id long, i int, quality int, part string"
    ).collect()
    parts.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 % (1 << 64), r[1]))
    seen = Counter(line for line in {(r[0], line) for r in parts for line in r[3].split("\n")} for line in [line[1]])
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for _, _, quality, part in parts:
        if kept := "\n".join(line for line in part.split("\n") if seen[line] == 1):
            texts[quality] += blocks_of(kept)
    scorer = Scorer(dictionary(texts[1]), dictionary(texts[0]))

    def measured(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, quality, text in rows:
            yield doc_id, quality, *scorer.features(text)

    found = map_rows(
        own.where("curve").select("doc_id", "quality", "text"), measured, "doc_id long, quality int, x double, s double, xs double"
    ).collect()
    found.sort()
    y = np.array([r[1] for r in found], float)
    if y.sum() in (0, len(y)):
        return Scorer(b"\n", b"\n", share=(good + 1) / (good + bad + 1))
    # each label was sampled at its own rate: weigh the constant back to the labels' shares
    weights = logistic(np.array([r[2:] for r in found]), y)
    weights[0] += np.log(good / bad) - np.log(y.sum() / (len(y) - y.sum()))
    scorer.weights = weights
    return scorer


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 2000) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 from ``GOOD`` on)."""
    scorer = fit(docs, labels, fit_rows)

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, held, text in rows:
            score = scorer.score(text)
            yield doc_id, held, score, int(score >= GOOD)

    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")), F.col("text").cast("string"))
    return map_rows(own, work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = 2000) -> DataFrame:
    """Documents that score as good, unchanged; the others go."""
    scorer = fit(docs, labels, fit_rows)

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        return (row for row in rows if scorer.score(row[1]) >= GOOD)

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return map_rows(docs.select(*DOCUMENT_COLUMNS), work, schema, chunk=64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
