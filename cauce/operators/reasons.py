"""Why a member gets an offer: driver phrases (F-37) and the decision's reason sentence (P-03)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauce.functions.money import cop_display

#: Wording of a feature as a reason; ``{}`` is its value as a whole number.
DRIVER_PHRASES = {
    "age": "tu edad ({} años)",
    "income": "tus ingresos",
    "job_tenure_months": "tus {} meses en el empleo",
    "internal_score": "tu puntaje interno",
    "debt_ratio": "tu nivel de endeudamiento",
    "digital_affinity": "tu afinidad digital",
    "dependents": "{} personas a cargo",
    "n_orders": "{} compras con nosotros",
    "months_since_event": "tu momento de vida reciente",
}
CHANNEL_PHRASES = {"whatsapp": "WhatsApp", "sms": "SMS", "email": "correo", "app": "la app", "callcenter": "llamada", "branch": "la oficina"}
WINDOW_PHRASES = {"morning": "en la mañana", "midday": "al mediodía", "afternoon": "en la tarde", "night": "en la noche"}
TIMING_PHRASES = {"life_event": "por tu evento de vida reciente", "new_member": "por tu ingreso a la caja", "cleared_credit": "por tu crédito ya pagado",
                  "seasonality": "por la temporada", "inmediato": "de inmediato"}


def _phrase(key: Column, phrases: dict[str, str]) -> Column:
    """The key's phrase; a key without one is its own name, underscores as blanks; null stays null."""
    table = F.create_map(*[F.lit(x) for pair in phrases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.replace(key, F.lit("_"), F.lit(" ")))


def listed(phrases: Column) -> Column:
    """``a, b y c``; null for none."""
    n = F.size(phrases)
    head = F.array_join(F.slice(phrases, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 1, F.get(phrases, F.lit(0))).when(n > 1, F.concat(head, F.lit(" y "), F.get(phrases, n - 1)))


def driver_reason(drivers: Column, phrases: dict[str, str] = DRIVER_PHRASES) -> Column:
    """Ranked drivers (structs with ``feature`` and ``value``) as one phrase, in their order.

    Null for no drivers. A null or NaN value drops the number's place, also its brackets.
    """
    def one(d: Column) -> Column:
        text, value = _phrase(d["feature"], phrases), d["value"].cast("double")
        number = F.when(value.isNotNull() & ~F.isnan(value), F.round(value).cast("bigint").cast("string"))
        without = F.trim(F.regexp_replace(text, r" ?\(\{\}[^)]*\)|\{\} ?", ""))
        return F.when(number.isNull(), without).otherwise(F.replace(text, F.lit("{}"), number))

    return listed(F.transform(drivers, one))


def decision_reason(product: Column, instalment: Column, channel: Column, window: Column, timing: Column, drivers: Column | None = None) -> Column:
    """The offer's sentence: drivers (if any), instalment within the payment capacity, channel, window and timing.

    Null without a product. A missing window, channel or timing leaves its clause out.
    """
    why = F.lit("") if drivers is None else F.coalesce(F.concat(F.lit(" por "), driver_reason(drivers)), F.lit(""))
    contact = F.coalesce(F.concat(F.lit("; te contactamos por "), _phrase(channel, CHANNEL_PHRASES), F.coalesce(F.concat(F.lit(" "), _phrase(window, WINDOW_PHRASES)), F.lit(""))), F.lit(""))
    pays = F.coalesce(F.concat(F.lit("; la cuota mensual de "), cop_display(instalment), F.lit(" no supera el 30% de tu ingreso disponible")), F.lit(""))
    when = F.coalesce(F.concat(F.lit(", "), _phrase(timing, TIMING_PHRASES)), F.lit(""))
    return F.concat(F.lit("Te recomendamos "), F.replace(product, F.lit("_"), F.lit(" ")), why, pays, contact, when, F.lit("."))


def with_reasons(decisions: DataFrame, drivers: DataFrame | None = None, key: str = "member_id") -> DataFrame:
    """Decisions (one row per member) with ``reason``; ``drivers`` has ``key`` and an array ``drivers``, at most a row per member."""
    if drivers is not None:
        decisions = decisions.join(drivers.select(key, "drivers"), key, "left")
    held = F.col("drivers") if drivers is not None else None
    out = decisions.withColumn("reason", decision_reason(F.col("primary_product"), F.col("instalment"), F.col("channel"), F.col("contact_window"), F.col("timing"), held))
    return out.drop("drivers") if drivers is not None else out
