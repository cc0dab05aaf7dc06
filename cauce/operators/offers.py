"""Rule-based offer engine over a whole member table (one ``select``, no UDF).

Per member: decline when the worst historical delinquency is 90+ days or
when the instalment capacity is not positive; otherwise pick the product by
interest priority, price it with the category rate, size the amount as the
French-amortisation inverse of 30 % of income scaled by available capacity,
and choose a consented channel, contact window and trigger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauce import fixed
from cauce.functions.channel import contact_window, consented_channel, trigger_event
from cauce.functions.money import amount_for_instalment, cop_display, instalment, rate_display

OFFER_COLUMNS = [
    "person_id", "person_name", "outcome", "detail", "product_id", "product_name",
    "amount_cop", "annual_rate_pct", "term_months", "cuota_cop", "channel",
    "contact_window", "trigger", "reason", "amount", "annual_rate", "cuota",
]


def _category_rate(categoria: Column) -> Column:
    """Rate lookup by category; unknown or missing category uses the default one."""
    expr = None
    for cat, rate in fixed.RATES_BY_CATEGORY.items():
        expr = F.when(categoria == cat, F.lit(rate)) if expr is None else expr.when(categoria == cat, F.lit(rate))
    return expr.otherwise(F.lit(fixed.RATES_BY_CATEGORY[fixed.DEFAULT_RATE_CATEGORY]))


def _product(intereses: Column) -> tuple[Column, Column]:
    """First interest rule that matches (case-insensitive, null-safe)."""
    lowered = F.transform(F.coalesce(intereses, F.array().cast("array<string>")), lambda x: F.lower(x))
    pid = name = None
    for interest, product_id, product_name in fixed.INTEREST_RULES:
        cond = F.array_contains(lowered, interest)
        pid = F.when(cond, F.lit(product_id)) if pid is None else pid.when(cond, F.lit(product_id))
        name = F.when(cond, F.lit(product_name)) if name is None else name.when(cond, F.lit(product_name))
    return pid.otherwise(F.lit(fixed.DEFAULT_PRODUCT[0])), name.otherwise(F.lit(fixed.DEFAULT_PRODUCT[1]))


def evaluate_offers(persons: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per input row with ``outcome`` in (offer, no_offer, error).

    ``keep`` names input columns passed through unchanged (e.g. batch keys).
    """
    keep = keep or []
    ingresos = F.col("ingresos").cast("double")
    capacidad = F.col("capacidad_endeudamiento_disponible_pct").cast("double")
    rate = _category_rate(F.col("categoria_afiliacion"))
    term = F.lit(fixed.DEFAULT_TERM_MONTHS)
    max_cuota = ingresos * fixed.INCOME_SHARE_FOR_INSTALMENT * (capacidad / 100.0)
    amount = amount_for_instalment(max_cuota, rate, term)
    cuota = instalment(amount, rate, term)
    product_id, product_name = _product(F.col("intereses"))
    interests = F.array_join(F.coalesce(F.col("intereses"), F.array().cast("array<string>")), ", ")
    interest_txt = F.when(interests == "", F.lit(fixed.NO_INTEREST_TEXT)).otherwise(interests)
    reason = F.concat(
        F.lit("Te recomendamos "), product_name, F.lit(" por tus intereses en "), interest_txt,
        F.lit(" y tu capacidad de pago disponible del "), F.format_string("%.0f", F.bround(capacidad, 0)), F.lit("%."),
    )
    declined_mora = F.coalesce(F.col("mora_maxima_historica") == fixed.DECLINE_MORA, F.lit(False))
    missing = F.col("ingresos").isNull() | F.col("capacidad_endeudamiento_disponible_pct").isNull()
    outcome = (F.when(declined_mora, "no_offer")
               .when(missing, "error")
               .when(max_cuota <= 0, "no_offer")
               .otherwise("offer"))
    detail = (F.when(declined_mora, "mora_maxima_historica = " + fixed.DECLINE_MORA)
              .when(missing, "missing income or capacity")
              .when(max_cuota <= 0, "max_cuota <= 0"))
    base = persons.select(
        *keep,
        F.col("cedula").alias("person_id"),
        F.coalesce(F.col("nombre"), F.lit("")).alias("person_name"),
        outcome.alias("outcome"), detail.alias("detail"),
        product_id.alias("product_id"), product_name.alias("product_name"),
        amount.alias("amount"), rate.alias("annual_rate"), term.alias("term_months"), cuota.alias("cuota"),
        consented_channel(F.col("consent_whatsapp"), F.col("telefono"), F.col("consent_email"), F.col("correo")).alias("channel"),
        contact_window(F.col("edad")).alias("contact_window"),
        trigger_event(F.col("momentos_clave")).alias("trigger"),
        reason.alias("reason"),
    )
    is_offer = F.col("outcome") == "offer"
    offered = [
        "product_id", "product_name", "amount", "annual_rate", "term_months", "cuota",
        "channel", "contact_window", "trigger", "reason",
    ]
    out = base
    for c in offered:
        out = out.withColumn(c, F.when(is_offer, F.col(c)))
    out = (out.withColumn("amount_cop", F.when(is_offer, cop_display(F.col("amount"))))
              .withColumn("annual_rate_pct", F.when(is_offer, rate_display(F.col("annual_rate"))))
              .withColumn("cuota_cop", F.when(is_offer, cop_display(F.col("cuota")))))
    return out.select(*keep, *OFFER_COLUMNS)
