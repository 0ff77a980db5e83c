"""Language identification by language-bitmask n-gram filters.

For each language, the character n-grams (words bounded by blanks) that are most frequent
among its sampled documents, and not far rarer than in another language (as in quotations),
enter a bit-sliced Bloom filter: slot i holds one bit for each
language, so that the AND of an n-gram's slots is the set of all languages that contain it.
A text's n-grams are looked up whole; the count of each language's bits, corrected for the
share of n-grams that its filter lets through by chance (fill to the power of the hashes),
decides.

Fitting takes a sample of about ``fit_rows`` documents of each language (by hash of doc_id),
and ``fit_grams`` n-grams of each language reach the driver.  lang, source and doc_id are
never inputs of a prediction.

Defined cases: ``und`` and score 0 for null texts, texts without a letter, and where nothing
could be learned; texts of any length are counted piece by piece; ties go to the language with
more learned documents, then by name; repeated rows and rows with equal doc_id are predicted
each on its own (and learned from as often as they are drawn); an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.llm.common import held_out, map_rows

QUERY = "op4_language_bitmask"
ORACLE_SQL = None

#: Lengths of n-grams, and hashes of each in the filter.
LENGTHS, HASHES = (3, 4), 3
#: An n-gram is a language's own if the share of documents that have it is this part of the largest share, at least.
OWN = 0.2
#: Characters of a text that are counted at a time.
PIECE = 1 << 16
_LETTER: list[np.ndarray] = []


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; anything but letters is 0, once in a row, and at both ends."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x30000)]))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes = np.where(_LETTER[0][np.minimum(codes, 0x2FFFF).astype(np.intp)], codes, 0)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint64)
    return codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]


def pieces_of(text: str) -> Iterator[str]:
    """The text in pieces that end before a blank: no n-gram spans a cut."""
    at = 0
    while len(text) - at > PIECE and (end := text.find(" ", at + PIECE)) >= 0:
        yield text[at:end]
        at = end
    yield text[at:]


def grams_of(text: str) -> np.ndarray:
    """Hashes of the n-grams of a piece, repeats included; those with a blank inside are left out."""
    codes = letters_of(text)
    found = []
    for n in LENGTHS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        value = np.full(size, n, np.uint64)
        inside = np.ones(size, bool)
        for i in range(n):
            part = codes[i : i + size]
            value = (value ^ part) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            if 0 < i < n - 1:
                inside &= part != 0
        found.append(value[inside])
    return np.concatenate(found) if found else np.empty(0, np.uint64)


class Filter:
    """Bit-sliced Bloom filter over the languages' n-grams; a word of 64 languages per plane."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]) -> None:
        self.languages = languages
        most = max([1, *map(len, grams)])
        self.bits = max(12, int(np.ceil(np.log2(12 * HASHES * most / 2))))
        kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
        self.wide = 8 * np.dtype(kind).itemsize
        self.planes = [np.zeros(1 << self.bits, kind) for _ in range(-(-len(languages) // self.wide) or 1)]
        for k, own in enumerate(grams):
            plane = self.planes[k // self.wide]
            for at in self.slots(own):
                plane[at] |= kind(1 << k % self.wide)
        fill = [float((self.planes[k // self.wide] >> kind(k % self.wide) & kind(1)).mean()) for k in range(len(languages))]
        self.chance = np.array(fill) ** HASHES

    def slots(self, grams: np.ndarray) -> list[np.ndarray]:
        """An n-gram's slots, one array per hash."""
        other = (grams * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        shift = np.uint64(64 - self.bits)
        return [((grams + np.uint64(i) * other) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.intp) for i in range(HASHES)]

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains."""
        at = self.slots(grams)
        found = []
        for plane in self.planes:
            mask = plane[at[0]]
            for slot in at[1:]:
                mask &= plane[slot]
            if self.wide == 8:
                by = np.bincount(mask, minlength=256)
                found += [int(by[np.arange(256) >> i & 1 == 1].sum()) for i in range(8)]
            else:
                found += [int((mask >> mask.dtype.type(i) & mask.dtype.type(1)).sum()) for i in range(self.wide)]
        return np.array(found[: len(self.languages)], float)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the best corrected count against the next one's."""
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        total, counts = 0, np.zeros(len(self.languages))
        for piece in pieces_of(text):
            grams = grams_of(piece)
            total += len(grams)
            counts += self.counts(grams)
        right = np.maximum(counts - total * self.chance, 0) / (1 - self.chance)
        best = int(right.argmax())
        if right[best] <= 0:
            return self.languages[best], 0.0
        next_best = float(np.delete(right, best).max()) if len(right) > 1 else 0.0
        return self.languages[best], float(right[best] / (right[best] + next_best))


def fit(docs: DataFrame, fit_rows: int = 1500, fit_grams: int = 20_000) -> Filter:
    """The filter of all languages among documents that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts, key=lambda k: (-counts[k], k))
    if not languages:
        return Filter([], [])
    spark = docs.sparkSession
    rates = spark.createDataFrame([(k, min(1.0, fit_rows / n)) for k, n in counts.items()], "lang string, rate double")
    draw = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30))
    some = known.join(F.broadcast(rates), "lang").where(draw < F.col("rate") * (1 << 30))

    def counted(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: Counter = Counter()
        for lang, text in rows:
            own = np.unique(np.concatenate([np.unique(grams_of(piece)) for piece in pieces_of(text)]))
            held.update((lang, g) for g in own.view(np.int64).tolist())
            if len(held) > 500_000:
                yield from ((k, g, n) for (k, g), n in held.items())
                held.clear()
        yield from ((k, g, n) for (k, g), n in held.items())

    sampled = {k: max(1.0, min(fit_rows, n)) for k, n in counts.items()}
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k in sampled.items() for x in k]), F.col("lang"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        map_rows(some.select("lang", "text"), counted, "lang string, gram long, n long", chunk=8192)
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("share", share)
        .withColumn("most", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= OWN * F.col("most"))
        .withColumn("at", F.row_number().over(order)).where(F.col("at") <= fit_grams)
        .groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams")).collect()
    )
    own = {r[0]: np.array(r[1], np.int64).view(np.uint64) for r in top}
    return Filter(languages, [own.get(k, np.empty(0, np.uint64)) for k in languages])


def identify(docs: DataFrame, fit_rows: int = 1500, fit_grams: int = 20_000) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score."""
    known = docs.sparkSession.sparkContext.broadcast(fit(docs, fit_rows, fit_grams))

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        known_here = known.value
        for doc_id, held, text in rows:
            yield doc_id, held, *known_here.predict(text)

    own = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")), F.col("text").cast("string"))
    return map_rows(own, work, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
