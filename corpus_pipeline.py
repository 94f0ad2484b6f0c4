"""A corpus from raw documents, stage by stage.

Each stage reads all that the one before kept: low-quality documents go, of equal and of
near-equal ones one stays, documents with passages of the benchmark go, and what is left
is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skysift.llm import _store, decontaminate, exact_dedup, ngram_join, quality, sentencepiece_codec
from skysift.llm import queries as q


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled ones among them, doesn't reject."""
    return quality.keep(docs, q.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by shingles of five words at a similarity of 0.8 the one with the smallest id."""
    return ngram_join.keep_one(docs, size=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words, or a shorter item, of the benchmark."""
    return decontaminate.remove(docs, q.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, with their count and digests."""
    return sentencepiece_codec.encode_decode(docs, q.piece_model(), with_ids=True).drop("decoded")


STAGES = [
    ("quality", filter_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]

#: A fitted network decides what the first stage keeps: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the written result of the one before."""
    docs = q.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else _store.staged(out, f"pipeline-{name}")
    return docs
