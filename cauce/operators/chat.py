"""Conversation jobs: intent tagging, escalation, outcomes, insurance hints,
response parsing and generated-text cleaning over whole text tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cauce import fixed
from cauce.functions.ids import strip_ws
from cauce.functions.text import ACCENTED, PLAIN, clean_generated, normalize_utterance


def normalised_phrases() -> list[tuple[str, str]]:
    """(topic, phrase) in the form utterances are compared in, each phrase once."""
    out = []
    for topic, phrases in fixed.TOPIC_PHRASES.items():
        for phrase in phrases:
            folded = phrase.lower().translate(str.maketrans(ACCENTED, PLAIN))
            pair = (topic, " ".join(re.findall("[a-z0-9]+", folded)))
            if pair not in out:
                out.append(pair)
    return out


def tag_intents(utterances: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``topics`` (distinct, sorted) and ``intent``: one topic, ambiguous or unknown.

    An utterance that is exactly a trigger phrase has that phrase's topics;
    otherwise the topics of all phrases it contains as whole words. Each topic
    is one regular expression over the normalised text (no join, no shuffle).
    """
    topics = sorted(fixed.TOPIC_PHRASES)
    pairs = normalised_phrases()
    columns = utterances.columns
    work = utterances.withColumn("__norm", normalize_utterance(F.col(text_col)))
    exact = [F.when(F.trim("__norm").isin([p for t, p in pairs if t == topic]), F.lit(topic)) for topic in topics]
    within = [F.when(F.regexp_like("__norm", F.lit(" (" + "|".join(p for t, p in pairs if t == topic) + ") ")), F.lit(topic)) for topic in topics]
    work = work.withColumn("__exact", F.array_compact(F.array(*exact))).withColumn("__within", F.array_compact(F.array(*within)))
    found = F.when(F.size("__exact") > 0, F.col("__exact")).otherwise(F.col("__within"))
    work = work.select(*columns, found.alias("topics"))
    n = F.size("topics")
    return work.withColumn("intent", F.when(n == 0, "unknown").when(n > 1, "ambiguous").otherwise(F.get("topics", F.lit(0))))


def escalations(turns: DataFrame) -> DataFrame:
    """Per conversation: unknown user turns and the turn at which the third occurs.

    ``row_number() <= 3`` keeps at most three rows of a conversation per task
    and kind before the shuffle (Spark's window group limit), so a conversation
    of any length moves six turns and one partial count. Unknown turns are told
    apart by a column, not a filter: Spark would push a filter below the tagging
    and normalise each text again for every phrase list.
    """
    tagged = tag_intents(turns.filter(F.col("role") == "user")).select("conv_id", "turn", (F.col("intent") == "unknown").alias("unknown"))
    order = Window.partitionBy("conv_id", "unknown").orderBy("turn")
    is_third = F.col("unknown") & (F.col("__k") == fixed.UNKNOWN_TURNS_TO_ESCALATE)
    third = (tagged.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= fixed.UNKNOWN_TURNS_TO_ESCALATE)
             .groupBy("conv_id").agg(F.max(F.when(is_third, F.col("turn"))).alias("escalation_turn")))
    counts = tagged.groupBy("conv_id").agg(F.count_if("unknown").alias("n_unknown"))
    convs = turns.select("conv_id").distinct()
    out = convs.join(counts, "conv_id", "left").join(third, "conv_id", "left")
    return out.select("conv_id", F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"),
                      F.col("escalation_turn").isNotNull().alias("escalated"), "escalation_turn")


def conversation_outcomes(turns: DataFrame) -> DataFrame:
    """Outcome per conversation: escalated, resolved_confirmed (thanks/goodbye) or resolved_implied."""
    tagged = tag_intents(turns.filter(F.col("role") == "user"))
    closing = tagged.groupBy("conv_id").agg(
        F.max(F.exists("topics", lambda t: t.isin("thank_you", "goodbye")).cast("int")).alias("__closing"),
        F.max(F.array_contains("topics", "escalate").cast("int")).alias("__asked"))
    esc = escalations(turns)
    j = esc.join(closing, "conv_id", "left")
    outcome = (F.when(F.col("escalated") | (F.coalesce("__asked", F.lit(0)) == 1), "escalated")
               .when(F.coalesce("__closing", F.lit(0)) == 1, "resolved_confirmed").otherwise("resolved_implied"))
    return j.select("conv_id", outcome.alias("outcome"))


def insurance_suggestions(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Up to two insurance products per text, in rule priority order (whole text
    scanned; whole words; a rule's second list must match too). A product's
    complement follows it."""
    padded = normalize_utterance(F.col(text_col))
    work = texts.select(id_col, padded.alias("__norm"))

    def has(words: list[str]):
        return F.regexp_like("__norm", F.lit(" (" + "|".join(words) + ") "))

    picks = []
    for any_of, and_any_of, product, complement in fixed.INSURANCE_RULES:
        hit = has(any_of) & has(and_any_of) if and_any_of else has(any_of)
        picks += [F.when(hit, F.lit(x)) for x in (product, complement) if x]
    found = F.array_distinct(F.array_compact(F.array(*picks)))
    return work.select(id_col, F.slice(found, 1, fixed.MAX_SUGGESTIONS).alias("suggestions"))


def clean_responses(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Cleaned text per row plus ``clean_ok`` (false = empty after cleaning)."""
    c = clean_generated(F.col(text_col))
    return texts.select(*keys, c.alias("cleaned_text"), c.isNotNull().alias("clean_ok"))


def parse_completions(raw: DataFrame, keys: list[str], raw_col: str = "raw") -> DataFrame:
    """Content of the first choice of a chat-completion JSON, or an error code.

    Uses the VARIANT type: ``try_parse_json`` (null = invalid JSON) and
    ``schema_of_variant`` for the shape checks, all inside the JVM.
    """
    v = F.try_parse_json(F.col(raw_col))
    kind = lambda x: F.schema_of_variant(x)
    choices = F.try_variant_get(v, "$.choices", "variant")
    first = F.try_variant_get(v, "$.choices[0]", "variant")
    message = F.try_variant_get(v, "$.choices[0].message", "variant")
    content_v = F.try_variant_get(v, "$.choices[0].message.content", "variant")
    content = F.try_variant_get(v, "$.choices[0].message.content", "string")
    finish = F.try_variant_get(v, "$.choices[0].finish_reason", "string")
    is_obj = lambda x: F.coalesce(F.startswith(kind(x), F.lit("OBJECT")), F.lit(False))
    code = (F.when(v.isNull(), "invalid_json")
            .when(~is_obj(v), "not_object")
            .when(~F.coalesce(F.startswith(kind(choices), F.lit("ARRAY")), F.lit(False)) | first.isNull(), "no_choices")
            .when(~is_obj(first), "bad_choice")
            .when(~is_obj(message), "bad_message")
            .when(~F.coalesce(kind(content_v) == "STRING", F.lit(False)) | (F.coalesce(F.length(strip_ws(content)), F.lit(0)) == 0), "empty")
            .when(finish == "length", "length")
            .when(finish == "content_filter", "content_filter"))
    return raw.select(*keys, code.alias("error_code"), F.when(code.isNull(), strip_ws(content)).alias("content"))
