"""Text expressions: generated-text cleaning, prompt fields, JSON lists, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cauce import fixed
from cauce.functions.ids import strip_ws

# FIXED VALUES: accent folding for e-mail local parts (source, target, same order)
ACCENTED = "áéíóúÁÉÍÓÚñÑüÜ"
PLAIN = "aeiouAEIOUnNuU"


def clean_generated(text: Column) -> Column:
    """Strip fences, unwrap bold, drop the first known prefix, strip paired quotes.

    Returns null when nothing is left (a generation failure).
    """
    t = strip_ws(text)
    t = F.regexp_replace(t, r"```[^\n]*\n?", "")
    t = F.replace(t, F.lit("```"), F.lit(""))
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "$1")
    low = F.lower(t)
    stripped = None
    for prefix in fixed.COMMON_PREFIXES:
        cond = F.startswith(low, F.lit(prefix.lower()))
        rest = strip_ws(F.substring(t, len(prefix) + 1, 1 << 30))
        stripped = F.when(cond, rest) if stripped is None else stripped.when(cond, rest)
    t = stripped.otherwise(t)
    quoted = (F.length(t) >= 1) & (
        (F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"'))) | (F.startswith(t, F.lit("'")) & F.endswith(t, F.lit("'"))))
    inner = F.when(F.length(t) >= 2, F.substring(t, 2, F.length(t) - 2)).otherwise(F.lit(""))
    t = strip_ws(F.when(quoted, inner).otherwise(t))
    return F.when(F.length(t) > 0, t)


def sanitize_prompt_field(value: Column) -> Column:
    """Braces become parentheses, CR/LF become spaces, then strip."""
    return strip_ws(F.translate(F.coalesce(value, F.lit("")), "{}\r\n", "()  "))


def load_labels(text: Column) -> Column:
    """JSON text -> array<string>; null, blank, malformed or non-array -> []."""
    parsed = F.from_json(text, "array<string>")
    return F.coalesce(parsed, F.array().cast("array<string>"))


def parse_list_value(text: Column) -> Column:
    """Python-repr or JSON list -> list; blank / [] / null -> []; scalar -> one-element list."""
    s = strip_ws(text)
    listed = F.startswith(s, F.lit("[")) & F.endswith(s, F.lit("]"))
    # Python-repr lists quote with ' unless the item holds one: items are cut
    # at the quotes and commas between them, and keep what quotes they contain
    inner = strip_ws(F.substring(s, 2, F.length(s) - 2))
    quoted = r"""\s*(?:'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)")\s*"""
    whole = F.regexp_like(inner, F.lit(rf"\A{quoted}(?:,{quoted})*,?\s*\z"))
    items = F.transform(F.regexp_extract_all(inner, F.lit(quoted), F.lit(0)), lambda x: F.regexp_replace(
        F.substring(strip_ws(x), 2, F.length(strip_ws(x)) - 2), r"\\(.)", "$1"))
    as_json = F.from_json(s, "array<string>")
    valid = F.schema_of_variant(F.try_parse_json(s)).startswith("ARRAY")
    scalar = F.regexp_replace(s, r"""^["']|["']$""", "")
    nothing = F.array().cast("array<string>")
    return (F.when(s.isNull() | (s == "") | (F.lower(s) == "nan"), nothing)
            .when(listed & (inner == ""), nothing)
            .when(listed & F.coalesce(valid, F.lit(False)) & as_json.isNotNull(), as_json)
            .when(listed & whole, items)
            .otherwise(F.array(scalar)))


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def whatsapp_link(phone: Column, message: Column) -> Column:
    """``wa.me/<phone>?text=<message>`` with spaces as %20."""
    return F.concat(F.lit("https://wa.me/"), phone, F.lit("?text="), F.replace(F.url_encode(message), F.lit("+"), F.lit("%20")))


def normalize_utterance(text: Column) -> Column:
    """Lower case, accents folded, punctuation to spaces, single spaces, padded."""
    t = fold_accents(F.lower(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(t, r"[^a-z0-9]+", " ")
    return F.concat(F.lit(" "), F.trim(t), F.lit(" "))
