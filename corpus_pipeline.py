"""From raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in
the shared folder and read again as the next one's docs.  All but the last return the
columns of documents; further columns of docs, whatever their names, are ignored.  Texts of any
length go through whole, and an empty table gives an empty result.

1. quality: documents that the compression classifier rejects go.
2. near_duplicates: of each component of texts whose sets of five-word shingles are similar
   by 0.8 or more (Jaccard, compared exactly), the document with the smallest doc_id stays.
   Golay keys of SimHash fingerprints give the first candidates, shared shingles the others.
3. secrets: every span that the scan finds is replaced by a mark; no document goes.
4. mix: documents are repeated, and the words of selected blocks taken, so that sources meet
   their target weights.
5. tokens: every row is encoded and decoded again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import bpe, mixing, quality, secrets, simhash
from grainmill.llm.common import cut


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good; fitted on the labelled ones.

    Null texts count as empty, and empty ones score as no evidence either way; every row, repeated ones and
    tied ids too, is judged by its text alone.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Null texts count as empty, and all of these are one group; repeated rows are one; of tied ids the text with the
    smaller hash stays; a row without doc_id stays only where its whole group has none.
    """
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their secrets.

    No row goes: null, empty and repeated ones, and tied ids, are all given back, null texts as they are.
    """
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources.

    Null and empty texts have no words, so they go; rows with equal doc_id and text share one plan, other ties are
    ordered by hash; a null source is a source of its own.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of the mix, and the round trip.

    One row for each row of docs, repeated ones and tied ids too; null texts count as empty and have no tokens.
    """
    return bpe.bpe_codec(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("secrets", redact),
    ("mix", mix),
    ("tokens", tokens),
]

#: Fitted and streaming stages have no SQL; they are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
