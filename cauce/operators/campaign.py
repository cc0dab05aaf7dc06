"""Campaign run: ids -> triage -> lookup -> offer -> message -> report.

The reference loops person by person with one lookup round trip each; here
the whole batch set is one job: a left join of accepted ids to the member
table, the offer ``select`` and two aggregates. A bad row never stops the
batch: every expression is null-safe and failures become ``error`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauce.operators.intake import accepted_ids, intake_counts, triage_ids
from cauce.operators.messages import compose_messages
from cauce.operators.offers import evaluate_offers


def lookup_persons(ids: DataFrame, persons: DataFrame) -> DataFrame:
    """Accepted ids left-joined to members; unmatched ids are ``person_not_found``.

    Sort-merge (or AQE-chosen broadcast) equi-join on the id; Catalyst
    prunes the member scan to the columns the offer engine reads.
    """
    p = persons.withColumnRenamed("cedula", "person_id").withColumn("__found", F.lit(True))
    return ids.join(p, "person_id", "left").withColumn("__found", F.coalesce(F.col("__found"), F.lit(False)))


def person_results(ids: DataFrame, persons: DataFrame) -> DataFrame:
    """One row per (batch, person): result_status + detail and the offer columns.

    One pass: the offer ``select`` runs over the left-joined frame and the
    not-found rows are labelled in the same projection (no union of two
    re-computed branches).
    """
    looked = lookup_persons(ids, persons).withColumnRenamed("person_id", "cedula")
    offers = evaluate_offers(looked, keep=["batch_id", "pos", "__found"])
    found = F.col("__found")
    status = (F.when(~found, "person_not_found")
              .when(F.col("outcome") == "offer", "processed").otherwise(F.col("outcome")))
    out = (offers.withColumn("result_status", status)
           .withColumn("detail", F.when(~found, F.lit("person not found")).otherwise(F.col("detail")))
           .withColumn("outcome", F.when(found, F.col("outcome")))
           .withColumn("person_name", F.when(found, F.col("person_name"))))
    return out.drop("__found")


def batch_report(results: DataFrame) -> DataFrame:
    """Per batch: total, processed, person_not_found, no_offer, errors."""
    return results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("result_status") == "processed").alias("processed"),
        F.count_if(F.col("result_status") == "person_not_found").alias("person_not_found"),
        F.count_if(F.col("result_status") == "no_offer").alias("no_offer"),
        F.count_if(F.col("result_status") == "error").alias("errors"),
    )


def run_campaign(uploads: DataFrame, persons: DataFrame) -> dict[str, DataFrame]:
    """All campaign outputs as lazy frames sharing one triage."""
    triaged = triage_ids(uploads)
    counts = intake_counts(triaged)
    ids = accepted_ids(triaged, counts)
    results = person_results(ids, persons)
    messages = compose_messages(results.filter(F.col("result_status") == "processed"))
    return {
        "triaged": triaged,
        "intake": counts,
        "results": results,
        "messages": messages,
        "report": batch_report(results),
    }
