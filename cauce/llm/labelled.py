"""Bounded, deterministic samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, use: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of documents that have a label and satisfy ``use`` (an expression
    on ``id_col``). Several labels of one id: the majority, ties count as 1."""
    marks = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(use)
             .groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y")))
    present = docs.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct()
    return marks.join(present, "id")


def sample(ids: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows first in hash order: the same at every run, whatever the partitions."""
    return ids.orderBy(F.xxhash64("id"), "id").limit(n)


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of a bounded sample of ids; an id that repeats keeps all its rows.
    ``ids`` holds at most the sample's bound of rows, so it is broadcast."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.join(F.broadcast(ids), "id").select("id", "text", "y")
