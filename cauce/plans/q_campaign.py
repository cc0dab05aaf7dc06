"""Campaign queries: intake, lookup, rule-based offers, messages, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.operators import campaign, intake, offers
from cauce.plans.oracle import sql
from cauce.plans.registry import register
from cauce.sources import derived


def _campaign(spark, sf_dir):
    return campaign.run_campaign(derived.id_uploads(spark, sf_dir), derived.persons(spark, sf_dir))


@register("campaign_report", "P-02, A-01, J-03, V-05, V-06, P-01", sql("""
SELECT batch_id, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE result_status = 'processed') AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE result_status = 'person_not_found') AS BIGINT) AS person_not_found,
       CAST(count(*) FILTER (WHERE result_status = 'no_offer') AS BIGINT) AS no_offer,
       CAST(count(*) FILTER (WHERE result_status = 'error') AS BIGINT) AS errors
FROM results GROUP BY batch_id""", "results"))
def campaign_report(spark, sf_dir):
    return _campaign(spark, sf_dir)["report"]


@register("id_triage", "S-01, V-01, V-02, V-03, V-04, V-05, W-01", sql(
    "SELECT batch_id, pos, raw_id, person_id, verdict FROM triaged", "triaged"))
def id_triage(spark, sf_dir):
    return intake.triage_ids(derived.id_uploads(spark, sf_dir))


@register("intake_counts", "A-03, V-06, V-07", sql(
    'SELECT batch_id, raw_count, "count", invalid_count, duplicate_count, gate FROM intake', "intake"))
def intake_counts(spark, sf_dir):
    return intake.intake_counts(intake.triage_ids(derived.id_uploads(spark, sf_dir)))


@register("person_lookup", "J-02, J-03", sql("""
SELECT batch_id, pos, person_id, result_status = 'person_not_found' AS not_found FROM results""", "results"))
def person_lookup(spark, sf_dir):
    res = _campaign(spark, sf_dir)["results"]
    return res.select("batch_id", "pos", "person_id", (F.col("result_status") == "person_not_found").alias("not_found"))


@register("rule_offers", "P-01, J-04, J-05, F-01, F-02, F-05, F-06, F-07, F-08, F-14, F-15, F-16, F-18, V-19", sql("""
SELECT person_id, person_name, outcome, detail, product_id, product_name, amount_cop, annual_rate_pct,
       term_months, cuota_cop, channel, contact_window, "trigger", reason FROM offers""", "offers"))
def rule_offers(spark, sf_dir):
    return offers.evaluate_offers(derived.persons(spark, sf_dir)).drop("amount", "annual_rate", "cuota")


@register("campaign_messages", "J-08, F-20, P-02", sql("""
SELECT batch_id, person_id, channel, contact_window, "trigger" AS trigger_event,
       CASE WHEN trim(person_name) = '' THEN 'Hola' ELSE 'Hola ' || regexp_replace(person_name, '^\\s+|\\s+$', '', 'g') END
       || ', tenemos una oferta de ' || product_name || ' para ti: monto ' || amount_cop || ', tasa ' || annual_rate_pct
       || ', plazo ' || CAST(term_months AS VARCHAR) || ' meses y cuota mensual de ' || cuota_cop || '. ' || reason AS message_text,
       'template' AS message_source
FROM results WHERE result_status = 'processed'""", "results"))
def campaign_messages(spark, sf_dir):
    m = _campaign(spark, sf_dir)["messages"]
    return m.select("batch_id", "person_id", "channel", "contact_window", F.col("trigger").alias("trigger_event"),
                    "message_text", "message_source")


@register("outbox_messages", "W-07, W-08, S-11, S-12, Q-01", sql("""
SELECT row_number() OVER (ORDER BY batch_id, person_id) AS message_id, batch_id, person_id AS cedula, product_id,
       channel, contact_window, "trigger" AS trigger_event, 'template' AS message_source, 'scheduled' AS status
FROM results WHERE result_status = 'processed'""", "results"))
def outbox_messages(spark, sf_dir):
    from cauce.operators.messages import outbox_rows  # noqa: PLC0415
    m = _campaign(spark, sf_dir)["messages"]
    return outbox_rows(m).select("message_id", "batch_id", "cedula", "product_id", "channel", "contact_window",
                                 "trigger_event", "message_source", "status")


@register("due_messages", "Q-04", sql("""
SELECT batch_id, CAST(count(*) AS BIGINT) AS n_due FROM results
WHERE result_status = 'processed' AND contact_window = 'night' GROUP BY batch_id""", "results"))
def due_messages(spark, sf_dir):
    """Messages due now (status scheduled, window of 20:00 = night), per batch."""
    m = _campaign(spark, sf_dir)["messages"].withColumn("status", F.lit("scheduled"))
    due = m.filter((F.col("status") == "scheduled") & (F.col("contact_window") == "night"))
    return due.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_due"))


@register("batch_status", "Q-02, A-04, A-28", sql("""
SELECT batch_id, 'completed' AS status, CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE result_status = 'processed') AS BIGINT) AS offers,
       round(count(*) FILTER (WHERE result_status IS NOT NULL) / CAST(count(*) AS DOUBLE), 10) AS progress
FROM results GROUP BY batch_id""", "results"))
def batch_status(spark, sf_dir):
    res = _campaign(spark, sf_dir)["results"]
    agg = res.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"),
                                      F.count_if(F.col("result_status") == "processed").alias("offers"),
                                      F.count_if(F.col("result_status").isNotNull()).alias("__done"))
    return agg.select("batch_id", F.lit("completed").alias("status"), "total", "offers",
                      F.round(F.try_divide(F.col("__done"), F.col("total")), 10).alias("progress"))


@register("offer_terms_parsed", "F-03, F-04", sql("""
SELECT person_id, CAST(TRY_CAST(regexp_replace(amount_cop, '[$.]', '', 'g') AS DECIMAL(18,2)) AS BIGINT) AS amount_value,
       CAST(TRY_CAST(trim(replace(replace(replace(annual_rate_pct, '% E.A.', ''), ',', '.'), '%', '')) AS DECIMAL(6,3)) AS DOUBLE) AS rate_value
FROM offers WHERE outcome = 'offer'""", "offers"))
def offer_terms_parsed(spark, sf_dir):
    from cauce.functions.money import parse_cop_display, parse_rate_display  # noqa: PLC0415
    o = offers.evaluate_offers(derived.persons(spark, sf_dir)).filter(F.col("outcome") == "offer")
    return o.select("person_id", parse_cop_display(F.col("amount_cop")).cast("bigint").alias("amount_value"),
                    parse_rate_display(F.col("annual_rate_pct")).cast("double").alias("rate_value"))


@register("orphan_messages", "J-10", sql("""
SELECT batch_id, CAST(count(*) AS BIGINT) AS n_messages,
       CAST(count(*) FILTER (WHERE person_id NOT IN (SELECT cedula FROM persons)) AS BIGINT) AS n_orphans
FROM results WHERE result_status = 'processed' GROUP BY batch_id""", "results", "persons"))
def orphan_messages(spark, sf_dir):
    from cauce.sources import store  # noqa: PLC0415
    m = _campaign(spark, sf_dir)["messages"].select("batch_id", "person_id")
    orph = store.orphans(m, derived.persons(spark, sf_dir), "person_id", "cedula").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_orphans"))
    tot = m.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return tot.join(orph, "batch_id", "left").select("batch_id", "n_messages",
                                                      F.coalesce("n_orphans", F.lit(0)).cast("bigint").alias("n_orphans"))
