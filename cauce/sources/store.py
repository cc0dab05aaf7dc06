"""Table writers: append, key upsert, replace, guarded registration.

Tables are parquet folders (the outbox partitioned by ``batch_id``); every
write is one Spark job with a partitioned file commit, and upserts are
anti-join + union on the key, so re-running a write is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``target`` whose key is not in ``incoming``, plus all of ``incoming``."""
    survivors = target.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return survivors.unionByName(incoming, allowMissingColumns=True)


def insert_absent(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Only the incoming rows whose key is not stored yet (register-once semantics)."""
    return incoming.join(target.select(*keys), keys, "left_anti")


def duplicate_keys(incoming: DataFrame, keys: list[str], target: DataFrame | None = None) -> DataFrame:
    """Keys repeated inside ``incoming`` or already present in ``target``; empty = safe bulk load."""
    dup = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys)
    if target is not None:
        dup = dup.unionByName(incoming.select(*keys).join(target.select(*keys), keys, "left_semi")).distinct()
    return dup


def update_status(batches: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply (batch_id, status, started_at, finished_at) updates; unknown batches are a no-op."""
    u = updates.select("batch_id", *[F.col(c).alias(f"__{c}") for c in ("status", "started_at", "finished_at")])
    j = batches.join(u, "batch_id", "left")
    for c in ("status", "started_at", "finished_at"):
        j = j.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c))).drop(f"__{c}")
    return j


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose foreign key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def append_outbox(messages: DataFrame, path: str) -> None:
    """Outbox append partitioned by batch; an empty batch id is stored as null."""
    (messages.withColumn("batch_id", F.nullif(F.col("batch_id"), F.lit("")))
     .write.mode("append").partitionBy("batch_id").parquet(path))
