"""Channel, contact window and trigger expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cauce import fixed


def _has_contact(value: Column) -> Column:
    """Contact data present: not null and not the empty string."""
    return F.coalesce(F.length(value) > 0, F.lit(False))


def consented_channel(consent_whatsapp: Column, phone: Column, consent_email: Column, email: Column) -> Column:
    """Opt-in and contact data both required: whatsapp, then email, else app."""
    wa = F.coalesce(consent_whatsapp, F.lit(False)) & _has_contact(phone)
    em = F.coalesce(consent_email, F.lit(False)) & _has_contact(email)
    return F.when(wa, "whatsapp").when(em, "email").otherwise("app")


def contact_window(age: Column) -> Column:
    """Under 40 -> night, else morning; a missing age counts as 40."""
    return F.when(F.coalesce(age, F.lit(fixed.DEFAULT_AGE)) < fixed.NIGHT_WINDOW_BELOW_AGE, "night").otherwise("morning")


def trigger_event(moments: Column) -> Column:
    """First life moment, else the immediate trigger (ANSI-safe ``get``)."""
    return F.coalesce(F.get(moments, 0), F.lit(fixed.DEFAULT_TRIGGER))


def affinity_band(affinity: Column) -> Column:
    """Digital affinity band: high >= 70, medium >= 45, else low."""
    return (F.when(affinity >= fixed.AFFINITY_HIGH, "high")
            .when(affinity >= fixed.AFFINITY_MEDIUM, "medium").otherwise("low"))


def allowed_channels(consent_whatsapp: Column, has_phone: Column, consent_email: Column, has_email: Column) -> Column:
    """Channels a member may be reached on: consented digital ones plus the fallbacks."""
    wa = F.when(F.coalesce(consent_whatsapp, F.lit(False)) & F.coalesce(has_phone, F.lit(False)), F.array(F.lit("whatsapp"), F.lit("sms")))
    em = F.when(F.coalesce(consent_email, F.lit(False)) & F.coalesce(has_email, F.lit(False)), F.array(F.lit("email")))
    base = F.array(F.lit("app"), F.lit("callcenter"), F.lit("branch"))
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(wa, empty), F.coalesce(em, empty), base)
