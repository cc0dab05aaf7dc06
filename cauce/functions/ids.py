"""Identifier expressions (column in, column out; all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cauce import fixed


def strip_ws(col: Column) -> Column:
    """Strip leading/trailing whitespace of every kind, like Python's ``str.strip``."""
    return F.regexp_replace(col, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def sanitize_id(raw: Column) -> Column:
    """Drop dots, strip, uppercase (``12.345.678`` -> ``12345678``, ``p001`` -> ``P001``)."""
    return F.upper(strip_ws(F.regexp_replace(raw, r"\.", "")))


def is_cedula(cleaned: Column) -> Column:
    """5 to 11 ASCII digits; ``[0-9]`` rejects Arabic-Indic and superscript digits."""
    return F.coalesce(cleaned.rlike(fixed.CEDULA_PATTERN), F.lit(False))


def is_synthetic_id(cleaned: Column) -> Column:
    """``P`` followed by 1 to 11 ASCII digits."""
    return F.coalesce(cleaned.rlike(fixed.SYNTHETIC_ID_PATTERN), F.lit(False))


def is_person_id(cleaned: Column) -> Column:
    return is_cedula(cleaned) | is_synthetic_id(cleaned)


def mask_phone(phone: Column) -> Column:
    """Show only the last four digits of a phone number."""
    return F.when(F.length(phone) > 0, F.concat(F.lit("******"), F.substring(phone, -4, 4)))
