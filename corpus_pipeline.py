"""Corpus pipeline: quality, toxicity, exact copies, near copies, packing.

Each stage takes what its predecessor kept (columns of ``documents``) and all
but the last return the same columns. ``run`` applies them to ``documents``.
The trained stages fit on bounded samples of the labelled rows among their own
input. Stages that keep one of several rows decide by row, so rows that repeat
an id with different texts are told apart by id and text. Null and empty texts
are judged like others (the last stage packs their end mark), repeated rows
each, and every stage of an empty table returns an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce.llm import exact_dedup, hyperminhash, packing, quality_classifier, toxicity
from cauce.llm.common import read, small_batches, staged

VOCABULARY = "byte_bpe_50k.json"
#: Near copies share four fifths of their shingles or more.
NEAR_PERCENT = 80
#: SQL has no way to train the two classifiers: the pipeline is tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise-ranked classifier accepts."""
    small_batches(spark)
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return quality_classifier.rejected_removed(docs, model)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the CRF does not find toxic."""
    small_batches(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.toxic_removed(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest id."""
    small_batches(spark)
    return exact_dedup.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates: that with the smallest id."""
    small_batches(spark)
    return hyperminhash.kept_documents(docs, percent=NEAR_PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality classifier", quality), ("toxicity", toxic), ("exact dedup", exact_copies), ("MinHash near-dedup", near_copies), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
