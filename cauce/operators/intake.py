"""ID intake: triage (valid / invalid / duplicate), batch size gate, counts.

Input is one row per uploaded cell: (batch_id, pos, raw_id). ``pos`` is the
cell's position in the upload, which fixes "first occurrence".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauce import fixed
from cauce.functions.ids import is_person_id, sanitize_id


def triage_ids(uploads: DataFrame) -> DataFrame:
    """Verdict per uploaded cell.

    valid = first occurrence of a well-formed id in its batch (input order);
    duplicate = every later occurrence (kept sanitized); invalid = malformed
    (raw text kept). The first position per (batch, id) comes from a partial
    ``min`` aggregate rather than a window, so a hot id repeated millions of
    times is combined map-side instead of landing in one task.
    """
    cleaned = uploads.select("batch_id", "pos", "raw_id", sanitize_id(F.col("raw_id")).alias("cleaned"))
    cleaned = cleaned.withColumn("well_formed", is_person_id(F.col("cleaned")))
    firsts = (cleaned.filter("well_formed").groupBy("batch_id", "cleaned")
              .agg(F.min("pos").alias("first_pos")))
    joined = cleaned.join(firsts, ["batch_id", "cleaned"], "left")
    verdict = (F.when(~F.col("well_formed"), "invalid")
               .when(F.col("pos") == F.col("first_pos"), "valid")
               .otherwise("duplicate"))
    return joined.select(
        "batch_id", "pos", "raw_id",
        F.when(F.col("well_formed"), F.col("cleaned")).alias("person_id"),
        verdict.alias("verdict"),
    )


def intake_counts(triaged: DataFrame, min_batch_size: int = fixed.MIN_BATCH_SIZE,
                  max_batch_size: int = fixed.MAX_BATCH_SIZE, max_raw_ids: int = fixed.MAX_RAW_IDS) -> DataFrame:
    """Per batch: raw, valid, invalid and duplicate counts plus the size gate.

    The gate is checked on the valid count: above the maximum rejects first,
    then below the minimum (0 disables the lower bound). The raw transport
    cap is checked before triage.
    """
    agg = triaged.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(F.col("verdict") == "valid").alias("count"),
        F.count_if(F.col("verdict") == "invalid").alias("invalid_count"),
        F.count_if(F.col("verdict") == "duplicate").alias("duplicate_count"),
    )
    gate = (F.when(F.col("raw_count") > max_raw_ids, "too_many_raw")
            .when(F.col("count") > max_batch_size, "too_large")
            .when(F.col("count") < min_batch_size, "too_small")
            .otherwise("accepted"))
    return agg.withColumn("gate", gate)


def accepted_ids(triaged: DataFrame, counts: DataFrame) -> DataFrame:
    """Valid ids of the batches that passed the gate: (batch_id, pos, person_id)."""
    ok = counts.filter(F.col("gate") == "accepted").select("batch_id")
    return (triaged.filter(F.col("verdict") == "valid")
            .join(ok, "batch_id", "left_semi")
            .select("batch_id", "pos", "person_id"))
