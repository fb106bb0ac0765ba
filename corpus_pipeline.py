"""Documents to tokens: quality rules, toxicity, near-duplicates, the mix of sources, byte-level BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, mixing, quality_rules, simhash, toxicity
from tessera.llm.common import stored, table
from tessera.llm.queries import byte_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep. A null or empty text has no words and goes; labels of rows that are not in docs count for nothing."""
    return quality_rules.passing(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. Without labels of both classes nobody is called so."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8: the one with the smallest id; a row without an id only
    where no row of its group has one. Rows that repeat an id with another text are documents of their own."""
    return simhash.without_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole; a null source is a source."""
    return mixing.drawn(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document of the mix."""
    return bpe.digests(docs, byte_bpe())


#: Each takes any columns beside those of documents, under any names, and an empty table gives an empty one.
STAGES = [("quality rules", quality), ("toxicity", clean), ("SimHash near-duplicates", distinct), ("mix", mix), ("byte-level BPE", encode)]

#: Fits and link search are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
