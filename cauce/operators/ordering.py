"""Skew-safe global ordering primitives.

A window ``row_number() OVER (ORDER BY ...)`` without ``PARTITION BY`` moves
every row into a single task, and ``PARTITION BY g`` does the same for a hot
group ``g``. These helpers compute the same ranks with the work spread over
range partitions:

1. ``repartitionByRange`` on the ordering keys (sampled bounds; a hot group
   is split over several partitions because the order keys inside it differ),
2. sort within each partition and number rows locally
   (``monotonically_increasing_id`` minus the partition base),
3. count rows per partition (one row per partition, a tiny table), turn the
   counts into start offsets with a window over that tiny table, and
4. add the offset back through a broadcast join (its size is the partition
   count, a parameter, not the data).

The ordering keys must be unique (append an id). The locally numbered frame
is materialised with a reliable ``checkpoint`` (in the shared folder named
by ``spark.checkpoint.dir``) before offsets are joined back: partition ids
are then facts on disk, not something a later re-plan (AQE local shuffle
reads, retries after a lost executor) could renumber, and the lineage of
long pipelines is cut at that point.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark import StorageLevel

_PID = "__pid"
_LOCAL = "__local"


def _materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; the frame is persisted first so the checkpoint
    write reuses the computed partitions instead of recomputing the lineage."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def _n_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def global_row_number(df: DataFrame, order: list[Column | str], out: str = "rn", n_partitions: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number()`` over ``order`` across the whole frame."""
    n = _n_partitions(df, n_partitions)
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    local = ranged.withColumn(_PID, F.spark_partition_id()).withColumn(
        _LOCAL, F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    local = _materialise(local)
    counts = local.groupBy(_PID).agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.select(
        _PID,
        (F.sum("__cnt").over(Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1))).alias("__off"),
    ).fillna(0, subset=["__off"])
    return (
        local.join(F.broadcast(offsets), _PID)
        .withColumn(out, F.col("__off") + F.col(_LOCAL) + 1)
        .drop(_PID, _LOCAL, "__off")
    )


def row_number_in_group(df: DataFrame, group: list[str], order: list[Column | str], out: str = "rn",
                        n_partitions: int | None = None) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` without a hot task.

    Global rank over (group, order), minus the group's first global rank.
    The per-group minimum is a partial aggregate and the join back is an
    equi-join AQE may split when one group is large.
    """
    ranked = global_row_number(df, [*group, *order], out="__g", n_partitions=n_partitions)
    starts = ranked.groupBy(*group).agg(F.min("__g").alias("__start"))
    return ranked.join(starts, group).withColumn(out, F.col("__g") - F.col("__start") + 1).drop("__g", "__start")


def cumulative_sums(df: DataFrame, order_col: str | list[str], sum_cols: list[str], n_partitions: int | None = None,
                    suffix: str = "_cum") -> DataFrame:
    """Running totals of ``sum_cols`` in ``order_col`` order (inclusive); ``order_col`` unique.

    Partition totals become offsets (one row per partition, broadcast) that
    are added to a within-partition running sum computed over Arrow batches
    of the sorted partition; no single-task window over the whole frame.
    """
    n = _n_partitions(df, n_partitions)
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    ranged = (df.repartitionByRange(n, *[F.col(c) for c in order]).sortWithinPartitions(*order)
              .withColumn(_PID, F.spark_partition_id()))
    w_off = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    schema = StructType(list(ranged.schema.fields))
    for c in sum_cols:
        schema = schema.add(f"__l_{c}", ranged.schema[c].dataType)

    def _running(batches):
        carry = dict.fromkeys(sum_cols, 0)
        for batch in batches:
            runs = []
            for c in sum_cols:
                values = batch.column(c)
                runs.append(pc.cumulative_sum(values, start=pa.scalar(carry[c], values.type), skip_nulls=True))
                carry[c] += pc.sum(values).as_py() or 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *runs], names=schema.names)

    local = _materialise(ranged.mapInArrow(_running, schema))
    totals = local.groupBy(_PID).agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    offsets = totals.select(_PID, *[F.coalesce(F.sum(f"__t_{c}").over(w_off), F.lit(0)).alias(f"__o_{c}") for c in sum_cols])
    out = local.join(F.broadcast(offsets), _PID)
    for c in sum_cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"__o_{c}") + F.col(f"__l_{c}"))
    return out.drop(_PID, *[f"__o_{c}" for c in sum_cols], *[f"__l_{c}" for c in sum_cols])
