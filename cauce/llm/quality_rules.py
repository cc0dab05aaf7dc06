"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Hashed word unigrams and bigrams of the whole corpus and of the trusted
documents give two multinomials over the same buckets. A document's verdict is
the mean log ratio (trusted over raw) of its n-grams against a fixed
threshold. Everything is a DataFrame expression; the only thing collected is
the table of ``buckets`` counts, whose size is a parameter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cauce.llm.common import ASCII_SPACE

BUCKETS = 8192
SMOOTHING = 1.0
#: Documents whose mean log ratio is lower fail.
THRESHOLD = -0.1
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _hashed(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Word hashes ``hw`` and bigram hashes ``h2`` of each text; one layer per
    step, so that no array is computed again inside a lambda."""
    kept = [F.col(c) for c in keep]
    out = docs.select(F.col(id_col).alias("__id"), *kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    out = out.select("*", F.btrim("__text", F.lit(ASCII_SPACE)).alias("__trim"))
    out = out.select("__id", *kept, "__text", F.when(F.col("__trim") == "", F.array().cast("array<string>"))
                     .otherwise(F.split("__trim", r"[\x20\x09-\x0D]+")).alias("__words"))
    out = out.select("__id", *kept, "__text", F.size("__words").alias("__n"), F.transform("__words", lambda w: F.xxhash64(w)).alias("__hw"))
    n = F.col("__n")
    pairs = F.zip_with(_cut("__hw", 1, n - 1), _cut("__hw", 2, n - 1), lambda a, b: F.xxhash64(a, b))
    return out.select("*", pairs.alias("__h2"))


def _cut(array: str, start: int, length: Column) -> Column:
    return F.slice(F.col(array), F.lit(start), F.greatest(length, F.lit(0)))


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents and of those whose
    id is in ``trusted`` (one column ``id_col``)."""
    marks = trusted.select(F.col(id_col).alias("__tid")).where(F.col("__tid").isNotNull()).distinct().withColumn("__target", F.lit(1))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__raw"))
    # marked before the n-grams are made: the join moves each text once, not its n-grams.
    # The trusted ids grow with the corpus: merged at every size, never broadcast
    marked = texts.join(marks.hint("merge"), texts["__id"] == marks["__tid"], "left")
    grams = _hashed(marked, "__id", "__raw", ["__target"]).select("__target", F.explode(F.concat("__hw", "__h2")).alias("__h"))
    return grams.groupBy(F.pmod("__h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("raw"), F.count("__target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_target / p_raw) of every bucket; ``buckets`` numbers."""
    raw, target = [0] * buckets, [0] * buckets
    for r in counts.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    all_raw, all_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    return [math.log((t + smoothing) / all_target) - math.log((r + smoothing) / all_raw) for r, t in zip(raw, target)]


def rule_scores(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, ``llr`` (mean log ratio; 0 without words) and verdicts, one row per input row."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratios)), ",").cast("array<double>")
    buckets = len(ratios)
    out = _hashed(docs, id_col, text_col, [])
    n = F.col("__n")
    out = out.select("*", F.zip_with(_cut("__h2", 1, n - 3), _cut("__h2", 3, n - 3), lambda a, b: F.xxhash64(a, b)).alias("__h4"))
    out = out.select("*", F.zip_with(_cut("__h4", 1, n - 4), _cut("__hw", 5, n - 4), lambda a, b: F.xxhash64(a, b)).alias("__h5"))
    # most texts repeat no window: only the others are sorted
    again = F.size(F.array_distinct("__h5")) < F.size("__h5")
    placed = F.sort_array(F.transform("__h5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    total = F.aggregate(F.concat("__hw", "__h2"), F.lit(0.0), lambda acc, h: acc + F.get(table, F.pmod(h, F.lit(buckets)).cast("int")))
    lines = F.filter(F.split("__text", "\n"), lambda line: F.btrim(line, F.lit(ASCII_SPACE)) != "")
    chars = F.length("__text")
    out = out.select("__id", "__n", F.when(again, placed).alias("__placed"),
                     F.when(n > 0, total / (F.size("__hw") + F.size("__h2"))).otherwise(F.lit(0.0)).alias("llr"), lines.alias("__lines"),
                     F.length(F.translate("__text", ASCII_SPACE, "")).cast("long").alias("word_chars"),
                     (chars - F.length(F.translate("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    def same(x, i):
        return F.coalesce(x["h"] == F.get(F.col("__placed"), i)["h"], F.lit(False))

    twice = F.filter("__placed", lambda x, i: same(x, i - 1) | same(x, i + 1))
    out = out.select("*", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
                     F.when(F.col("__placed").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["i"]))).alias("__at"))
    covered = F.aggregate(F.zip_with("__at", F.slice("__at", 2, F.greatest(F.size("__at"), F.lit(1))), lambda a, b: F.least(b - a, F.lit(WINDOW))),
                          F.lit(0), lambda acc, x: acc + x)
    out = out.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (n < MIN_WORDS) | (F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT)
    return out.select(F.col("__id").alias(id_col), n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")


def quality_rules(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base rules and the ratio's verdict for every document.

    Null and empty texts have no words and fail the base rules. Repeated rows
    are judged alike. Without trusted documents all ratios follow the raw
    counts' smoothing only; an empty table gives no rows.
    """
    ratios = log_ratios(bucket_counts(docs, trusted, buckets, id_col, text_col), buckets)
    return rule_scores(docs, ratios, threshold, id_col, text_col)
