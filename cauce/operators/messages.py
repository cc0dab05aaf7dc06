"""Message composition: template text, generated-text fallback, outbox rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauce import fixed
from cauce.functions.ids import strip_ws
from cauce.operators.ordering import global_row_number


def template_text(name: Column, product_name: Column, amount_cop: Column, rate_pct: Column,
                  term_months: Column, cuota_cop: Column, reason: Column) -> Column:
    """Deterministic message; a blank name degrades to a name-free greeting."""
    clean = strip_ws(F.coalesce(name, F.lit("")))
    greeting = F.when(clean == "", F.lit("Hola")).otherwise(F.concat(F.lit("Hola "), clean))
    return F.concat(
        greeting, F.lit(", tenemos una oferta de "), product_name, F.lit(" para ti: monto "), amount_cop,
        F.lit(", tasa "), rate_pct, F.lit(", plazo "), term_months.cast("string"),
        F.lit(" meses y cuota mensual de "), cuota_cop, F.lit(". "), reason,
    )


def benefits_text(reason: Column, amount_cop: Column, rate_pct: Column, term_months: Column, cuota_cop: Column) -> Column:
    """Offer context handed to a text generator (reason + financial terms)."""
    return F.concat(
        reason, F.lit(" Monto: "), amount_cop, F.lit(" · Tasa: "), rate_pct, F.lit(" · Plazo: "),
        term_months.cast("string"), F.lit(" meses · Cuota: "), cuota_cop,
    )


def compose_messages(offers: DataFrame, generated: DataFrame | None = None) -> DataFrame:
    """Message text per offer: generated text when present and usable, else template.

    ``generated`` (batch_id, person_id, text) holds texts produced elsewhere
    (for example by ``mapInPandas`` over the prompt table); it is left-joined on
    batch and person. Of several texts of one offer the first usable one in
    text order counts, so an offer stays one message. Channels outside whatsapp/sms/email always use the template.
    """
    tmpl = template_text(F.col("person_name"), F.col("product_name"), F.col("amount_cop"), F.col("annual_rate_pct"),
                         F.col("term_months"), F.col("cuota_cop"), F.col("reason"))
    df = offers.filter(F.col("outcome") == "offer")
    if generated is None:
        return df.withColumn("message_text", tmpl).withColumn("message_source", F.lit("template"))
    keys = ["batch_id", "person_id"] if "batch_id" in generated.columns else ["person_id"]
    texts = generated.select(*keys, F.nullif(strip_ws(F.col("text")), F.lit("")).alias("__gen"))
    df = df.join(texts.groupBy(*keys).agg(F.min("__gen").alias("__gen")), keys, "left")
    usable = F.col("channel").isin(*fixed.GENERATED_TEXT_CHANNELS) & F.coalesce(F.length("__gen") > 0, F.lit(False))
    return (df.withColumn("message_text", F.when(usable, F.col("__gen")).otherwise(tmpl))
              .withColumn("message_source", F.when(usable, "llm").otherwise("template"))
              .drop("__gen"))


def outbox_rows(messages: DataFrame, batch_col: str = "batch_id", id_offset: int = 0) -> DataFrame:
    """Rows for ``scheduled_messages`` with monotone ids ordered by (batch, person).

    ``id_offset`` is the largest id already stored. Ids come from the
    distributed global rank, not ``monotonically_increasing_id`` (which is
    neither dense nor stable across re-runs).
    """
    ranked = global_row_number(messages, [F.col(batch_col), F.col("person_id")], out="__rn")
    return ranked.select(
        (F.col("__rn") + F.lit(id_offset)).alias("message_id"),
        F.nullif(F.col(batch_col), F.lit("")).alias("batch_id"),
        F.col("person_id").alias("cedula"),
        "product_id",
        F.col("amount_cop"),
        F.col("annual_rate_pct"),
        "term_months",
        F.col("cuota_cop"),
        "channel", "contact_window",
        F.col("trigger").alias("trigger_event"),
        "message_text", "message_source",
        F.lit("scheduled").alias("status"),
    )
