"""Prompt table for an external text generator (F-22) and the check of its inputs (F-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauce.functions.ids import strip_ws
from cauce.functions.text import sanitize_prompt_field
from cauce.operators.messages import benefits_text

# FIXED VALUES: the prompt's wording, per channel its name and its rules
INSTRUCTION = ("Menciona los beneficios listados arriba, copiando los valores numéricos (tasas, montos, plazos y cuotas) "
               "exactamente como aparecen, sin modificarlos, redondearlos ni inventar otros.")
CHANNEL_NAMES = {"whatsapp": "WhatsApp", "sms": "SMS", "email": "correo electrónico"}
CHANNEL_RULES = {
    "whatsapp": ["1 a 3 oraciones cortas.", "Puedes usar emojis para dar calidez.", "Tono conversacional, como un mensaje entre amigos.",
                 "Solo el texto del mensaje, nada más."],
    "sms": ["1 o 2 oraciones máximo.", "Aproximadamente 160 caracteres.", "Sin emojis.", "Directo y conciso.", "Solo el texto del mensaje, nada más."],
    "email": ["2 a 4 oraciones.", "Incluye un saludo inicial (ej. 'Hola María,') y una despedida cordial.",
              "Más detallado pero manteniendo un tono amigable y cercano.", "Sin asunto (subject), solo el cuerpo del correo.",
              "Solo el texto del mensaje, nada más."],
}


def prompt_error(name: Column, product: Column, channel: Column) -> Column:
    """Why there is no prompt: blank_name, blank_product, unknown_channel, or null. Null counts as blank and as unknown."""
    blank = lambda c: strip_ws(F.coalesce(c, F.lit(""))) == ""
    return (F.when(blank(name), "blank_name").when(blank(product), "blank_product")
            .when(~F.coalesce(channel.isin(*CHANNEL_NAMES), F.lit(False)), "unknown_channel"))


def prompt_text(name: Column, product: Column, benefits: Column, channel: Column) -> Column:
    """The channel's prompt; null for an unknown channel. Fields lose braces and line
    breaks, so a field cannot open a section of its own."""
    tags = [F.concat(F.lit(f"<{tag}>"), sanitize_prompt_field(c), F.lit(f"</{tag}>\n")) for tag, c in (("persona", name), ("producto", product), ("beneficios", benefits))]
    task = None
    for slug, label in CHANNEL_NAMES.items():
        rules = "\n".join(f"- {r}" for r in CHANNEL_RULES[slug])
        text = F.lit(f"\nCrea un mensaje de {label} para la persona recomendando el producto. {INSTRUCTION}\n\nReglas:\n{rules}")
        task = F.when(channel == slug, text) if task is None else task.when(channel == slug, text)
    return F.concat(*tags, task)


def prompt_table(offers: DataFrame, keys: list[str]) -> DataFrame:
    """Per offer its keys, channel, prompt and error; exactly one of the two last is null."""
    name, product, channel = F.col("person_name"), F.col("product_name"), F.col("channel")
    benefits = benefits_text(F.col("reason"), F.col("amount_cop"), F.col("annual_rate_pct"), F.col("term_months"), F.col("cuota_cop"))
    error = prompt_error(name, product, channel)
    return offers.select(*keys, "channel", F.when(error.isNull(), prompt_text(name, product, benefits, channel)).alias("prompt"), error.alias("error"))
