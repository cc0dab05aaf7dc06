"""Status logs checked against a table of allowed moves, and guarded updates.

A log's valid history is followed move by move from the first status: each
round finds, per key, the first later event that the table allows from the
key's state. The table has no cycle, so there are as many rounds as its longest
chain has moves, and no key's events are gathered in one place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce import fixed
from cauce.session import shared_path


def longest_chain(moves: list[tuple[str, str]]) -> int:
    """Moves of the longest chain; a cycle is refused."""
    def depth(status: str, seen: tuple[str, ...]) -> int:
        if status in seen:
            raise ValueError(f"status moves with a cycle through {status}")
        return max((1 + depth(b, (*seen, status)) for a, b in moves if a == status), default=0)
    return max((depth(a, ()) for a, _ in moves), default=0)


def _allowed(state: Column, status: Column, moves: list[tuple[str, str]]) -> Column:
    out = F.lit(False)
    for a, b in moves:
        out = out | ((state == a) & (status == b))
    return out


def valid_history(log: DataFrame, moves: list[tuple[str, str]] = fixed.STATUS_MOVES, key: str = "batch_id", order: tuple[str, ...] = ("ts", "event_id"), status: str = "status") -> DataFrame:
    """(key, history): the valid states of each key with the events that set
    them, in order. A key begins with its first event of a status that no move
    leads to; a key without one has an empty history. Null keys are no keys."""
    starts = sorted({a for a, _ in moves} - {b for _, b in moves})
    at = F.struct(*order)
    events = log.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), at.alias("at"), F.col(status).alias("status"))
    first = F.min(F.when(F.col("status").isin(starts), F.struct("at", "status")))
    state = events.groupBy("__key").agg(first.alias("last"))
    kind = state.schema["last"].dataType.simpleString()
    state = state.withColumn("history", F.when(F.col("last").isNull(), F.lit(None).cast(f"array<{kind}>")).otherwise(F.array("last")))
    for _ in range(longest_chain(moves)):
        later = events.join(state.where("last is not null").select("__key", "last"), "__key")
        later = later.where((F.col("at") > F.col("last.at")) & _allowed(F.col("last.status"), F.col("status"), moves))
        step = later.groupBy("__key").agg(F.min(F.struct("at", "status")).alias("next"))
        state = state.join(step, "__key", "left").select("__key", F.col("next").alias("last"), F.when(F.col("next").isNull(), F.col("history")).otherwise(F.array_append("history", F.col("next"))).alias("history"))
    return state.select(F.col("__key").alias(key), F.coalesce("history", F.array().cast(f"array<{kind}>")).alias("history"))


def checked_log(log: DataFrame, moves: list[tuple[str, str]] = fixed.STATUS_MOVES, statuses: list[str] = fixed.BATCH_STATUSES, key: str = "batch_id",
                order: tuple[str, ...] = ("ts", "event_id"), status: str = "status") -> DataFrame:
    """All columns of ``log``, with ``state`` (of the key before the event, null
    before its first) and ``verdict``: accepted, unknown_status (also a null),
    repeated (the state it has), late (after an end) or illegal. Rejected events
    change nothing. Rows with a null key are illegal; of rows that repeat an
    accepted event's order and status each is accepted."""
    at, ends = F.struct(*order), sorted({b for _, b in moves} - {a for a, _ in moves})
    seen = log.join(valid_history(log, moves, key, order, status).withColumnRenamed("history", "__h"), key, "left").withColumn("__at", at)
    before = F.filter("__h", lambda e: e["at"] < F.col("__at"))
    taken = F.exists("__h", lambda e: (e["at"] == F.col("__at")) & (e["status"] == F.col(status)))
    seen = seen.withColumn("state", F.try_element_at(before, F.lit(-1))["status"])
    verdict = (F.when(~F.coalesce(F.col(status).isin(statuses), F.lit(False)), "unknown_status").when(F.coalesce(taken, F.lit(False)), "accepted")
               .when(F.col("state") == F.col(status), "repeated").when(F.col("state").isin(ends), "late").otherwise("illegal"))
    return seen.select(*log.columns, "state", verdict.alias("verdict"))


def latest_states(log: DataFrame, moves: list[tuple[str, str]] = fixed.STATUS_MOVES, key: str = "batch_id", order: tuple[str, ...] = ("ts", "event_id"), status: str = "status") -> DataFrame:
    """(key, status, moves): the latest valid state of each key and how many valid events it had."""
    h = valid_history(log, moves, key, order, status)
    return h.select(key, F.try_element_at("history", F.lit(-1))["status"].alias("status"), F.size("history").cast("long").alias("moves"))


# ---------------------------------------------------------------- guarded updates

#: Moves of an outbox message.
MESSAGE_MOVES = [("scheduled", "pending"), ("pending", "sent")]


def compare_and_set(rows: DataFrame, updates: DataFrame, moves: list[tuple[str, str]] = MESSAGE_MOVES, key: str = "message_id", time_col: str = "sent_at", end: str = "sent") -> DataFrame:
    """``rows`` with the updates that hold: (key, expected, status, at).

    An update holds where the stored status is the expected one and the move is
    allowed; ``at`` goes to ``time_col`` when the new status is ``end``. Of
    several that hold for a row the earliest counts, then the first status in
    text order. Unknown keys, nulls and repeated updates change nothing, so
    applying the same updates again does not either.
    """
    u = updates.select(F.col(key).alias("__key"), F.col("expected").alias("__e"), F.col("status").alias("__s"), F.col("at").alias("__at"))
    u = u.where(F.col("__key").isNotNull() & _allowed(F.col("__e"), F.col("__s"), moves))
    u = u.groupBy("__key", "__e").agg(F.min(F.struct("__at", "__s")).alias("__u"))
    j = rows.join(u, (F.col(key) == F.col("__key")) & (F.col("status") == F.col("__e")), "left")
    new = F.col("__u")["__s"]
    kept = [F.coalesce(new, F.col(c)).alias(c) if c == "status" else F.when(new == end, F.col("__u")["__at"]).otherwise(F.col(c)).alias(c) if c == time_col else F.col(c) for c in rows.columns]
    return j.select(*kept)


def apply_updates(spark: SparkSession, path: str, updates: DataFrame, partition: str = "batch_id", **how) -> None:
    """``compare_and_set`` on a stored table: ``updates`` also name the partition,
    and only partitions with an update are read and replaced, each by a rename
    of whole files. A writer lost half way leaves every partition old or new; the
    same call again finishes the rest and changes nothing in those already new."""
    touched = updates.select(partition).where(F.col(partition).isNotNull()).distinct()
    stored = spark.read.parquet(path)
    mine = stored.join(touched, partition, "left_semi")
    draft = shared_path(spark, f"updates-{uuid.uuid4().hex}")
    compare_and_set(mine, updates.drop(partition), **how).select(*stored.columns).write.parquet(draft)
    spark.read.parquet(draft).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


# ---------------------------------------------------------------- governance

def governed(values: DataFrame, as_of: Column, member: str = "member_id") -> DataFrame:
    """All columns and ``governance`` of feature values with source, legal_basis,
    consent, observed (date) and ttl_days.

    no_legal_basis where it is null, blank or unknown, then no_consent where
    consent is not true, then not_yet (observed after ``as_of``), then stale (older than its ttl;
    a value is active on its last day), else active. A null observed date or ttl is stale.
    """
    basis = F.lower(F.trim(F.coalesce(F.col("legal_basis"), F.lit(""))))
    age = F.datediff(as_of, F.col("observed"))
    state = (F.when(basis.isin("", "unknown"), "no_legal_basis").when(~F.coalesce(F.col("consent"), F.lit(False)), "no_consent")
             .when(age < 0, "not_yet").when(F.coalesce(age <= F.col("ttl_days"), F.lit(False)), "active").otherwise("stale"))
    return values.withColumn("governance", state)
