"""Corpus pipeline: quality, exact dedup, near-dedup, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents.  Empty tables stay empty, columns beyond those of documents are kept as they are, rows that
repeat an id are documents of their own, very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, queries
from sparkloom.llm.common import discard, materialize
from sparkloom.llm.exact_dedup import unique_texts
from sparkloom.llm.mixing import mixed_documents
from sparkloom.llm.near_dedup import unique_documents
from sparkloom.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, null and empty texts among them; without any trusted label all
    texts stay."""
    return keep_good(docs, queries.trusted_ids(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that of the largest doc_id; null counts as the empty text."""
    return unique_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five-word shingles, similarity 0.8) one row stays, that of the smallest doc_id; rows without
    words or without an id stay all."""
    return unique_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, in the order of its slots; those without words stay once."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text that the mix has, and the digest of what they decode to."""
    return queries.digests(bpe.round_trip(docs, queries.tokenizer_path()))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", tokenize)]

#: The stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has written goes as soon as the next one has."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
