"""Typed persons and their stored form: decimals, bits and JSON arrays (V-18), defaults (V-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauce.functions.ids import strip_ws

# FIXED VALUES: stored types of the person columns and defaults of missing values
DECIMALS = {"ingresos": "decimal(18,2)", "deuda_total_acumulada_cop": "decimal(18,2)", "cuota_mensual_total_cop": "decimal(18,2)", "capacidad_endeudamiento_disponible_pct": "decimal(5,2)"}
INTEGERS = ["edad", "score_datacredito", "num_creditos_activos"]
BITS = ["consent_whatsapp", "consent_email"]
LABELS = ["area_trabajo", "intereses", "preferencias", "momentos_clave", "composicion_familiar", "historial_creditos"]
DEFAULTS = {"consent_whatsapp": False, "consent_email": False, "num_creditos_activos": 0, "deuda_total_acumulada_cop": 0.0, "cuota_mensual_total_cop": 0.0,
            "capacidad_endeudamiento_disponible_pct": 0.0, "mora_maxima_historica": "0_DIAS"}


def to_stored(persons: DataFrame) -> DataFrame:
    """Typed persons as stored rows: decimals of two places, bits as 0 and 1, arrays as
    JSON text. Null stays null. A number that its decimal cannot hold (NaN, too large) fails the job."""
    def stored(c: str) -> Column:
        if c in DECIMALS:
            return F.col(c).cast(DECIMALS[c])
        if c in BITS:
            return F.col(c).cast("int")
        return F.to_json(c) if c in LABELS else F.col(c)
    return persons.select(*[stored(c).alias(c) for c in persons.columns])


def _is_json_array(text: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("ARRAY")), F.lit(False))


def from_stored(rows: DataFrame) -> DataFrame:
    """Stored rows (typed or as text) as typed persons, with ``errors``.

    ``errors`` holds (field, value) of every value that its type cannot read, in
    column order: such a number or bit is null, such labels are empty, and the row
    stays. A missing value (null) takes its default; missing or blank labels are
    empty and no error. Other columns are kept.
    """
    typed, errors = [], []
    for c in rows.columns:
        text = F.col(c).cast("string")
        if c in LABELS:
            good = _is_json_array(text)
            value = F.when(good, F.from_json(text, "array<string>")).otherwise(F.array().cast("array<string>"))
            bad = (strip_ws(text) != "") & ~good
        elif c in DECIMALS or c in INTEGERS or c in BITS:
            kind = "boolean" if c in BITS else "int" if c in INTEGERS else DECIMALS[c]
            value = strip_ws(text).try_cast(kind)
            bad = text.isNotNull() & value.isNull()
            value = value.cast("double") if c in DECIMALS else value
        else:
            value, bad = F.col(c), None
        if c in DEFAULTS:
            value = F.when(F.col(c).isNull(), F.lit(DEFAULTS[c])).otherwise(value)
        typed.append(value.alias(c))
        if bad is not None:
            errors.append(F.when(bad, F.struct(F.lit(c).alias("field"), text.alias("value"))))
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<struct<field:string,value:string>>")
    return rows.select(*typed, found.alias("errors"))
