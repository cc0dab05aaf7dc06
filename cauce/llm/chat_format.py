"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role become one message by array functions; messages are concatenated in a
template of control marks. Control strings inside texts are escaped so that
the output reads back exactly, turn by turn. The loss mask covers each
assistant text, and neither marks nor what stands between merged texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: Escapes, applied in this order and undone in the reverse one. With no "<"
#: left, a text holds no mark of this template nor tags such as </s>.
_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[INST]", "&lsqb;INST]"), ("[/INST]", "&lsqb;/INST]")]


def escape(text: Column) -> Column:
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("[", "&lsqb;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` holds (message, start, length): code points from the start
    of that message, messages ending after the end mark. Rows sort by turn
    (null first), then role, then text; repeated rows stay. Null text and role
    are empty, null conversation ids are one conversation. One conversation is
    one output string, so its turns meet in one row; other columns are not read.
    """
    clean = turns.select(F.col(conv_id).alias("__conv"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("__turn"))
    out = clean.groupBy("__conv").agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    out = out.select("*", F.size("__turns").alias("__n"))
    first = F.filter(F.transform("__turns", lambda t, i: F.when(
        (i == 0) | (t["role"] != F.get(F.col("__turns"), i - 1)["role"]), i)), lambda i: i.isNotNull())
    out = out.select("*", first.alias("__first"))
    bounds = F.zip_with("__first", F.concat(F.slice("__first", 2, F.size("__first")), F.array("__n")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    out = out.select("__conv", "__turns", bounds.alias("__bounds"), "__n")
    merged = F.transform("__bounds", lambda x: F.struct(
        F.get(F.col("__turns"), x["a"])["role"].alias("role"),
        F.transform(F.slice(F.col("__turns"), x["a"] + 1, x["b"] - x["a"]), lambda t: escape(t["text"])).alias("texts")))
    out = out.select("__conv", merged.alias("__messages"), F.size("__bounds").alias("__m"))
    head = lambda m: F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform("__messages", lambda m: F.concat(head(m), F.array_join(m["texts"], SEP), F.lit(END))), "")
    spans = F.flatten(F.transform("__messages", lambda m, k: F.when(m["role"] == ASSISTANT, _spans(m["texts"], F.length(head(m)), k))
                                  .otherwise(F.array().cast("array<struct<message:int,start:int,length:int>>"))))
    return out.select(F.col("__conv").alias(conv_id), formatted.alias("formatted"), spans.alias("loss_spans"))


def _spans(texts: Column, start: Column, message: Column) -> Column:
    """Places of the texts of one message, counted from ``start``."""
    empty = F.array().cast("array<struct<message:int,start:int,length:int>>")
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t) + len(SEP)).alias("at"),
        F.concat(acc["spans"], F.array(F.struct(message.alias("message"), acc["at"].alias("start"), F.length(t).alias("length")))).alias("spans"))
    return F.aggregate(texts, F.struct(start.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def read_conversations(formatted: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Turns and loss texts read back from ``formatted`` and ``loss_spans``:
    ``turns`` (role, text in order) and ``loss_texts``."""
    out = formatted.select(F.col(conv_id).alias("__conv"), "formatted", "loss_spans")
    parts = F.split("formatted", r"(?<=<\|im_end\|>\n)")
    out = out.select("*", F.filter(parts, lambda p: p != "").alias("__parts"), F.length("formatted").alias("__chars"))
    body = lambda p: F.substring(p, len(START) + 1, F.length(p) - len(START) - len(END))
    turns = F.flatten(F.transform("__parts", lambda p: F.transform(
        F.split(F.substr(body(p), F.instr(body(p), "\n") + 1), r"<\|im_sep\|>"),
        lambda t: F.struct(_unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"), unescape(t).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.get(F.col("__parts"), s["message"]), s["start"] + 1, s["length"])))
    return out.select(F.col("__conv").alias(conv_id), turns.alias("turns"), loss.alias("loss_texts"), F.col("__chars").alias("formatted_chars"))
