"""Feature encoder: numeric passthrough, one-hot, ordinal, multi-label flags.

``fit`` learns the sorted vocabularies (one aggregation pass over all label
columns; vocabularies are categorical domains, so they are small);
``transform`` is a single wide ``select`` of column expressions, so the
encoded frame is produced by whole-stage codegen without a shuffle.
Vocabularies persist as a small parquet table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce import fixed
from cauce.operators.quality import label_vocabularies


def _name(col: str, value: str) -> str:
    return f"{col}_{re.sub(r'[^0-9A-Za-z_]+', '_', value)}"


class FeatureEncoder:
    """Fit once, transform many, save and load."""

    def __init__(self, vocab: dict[str, list[str]] | None = None):
        self.vocab = vocab or {}

    def fit(self, df: DataFrame) -> "FeatureEncoder":
        onehot = df.select(*[F.array(F.col(c)).alias(c) for c in fixed.ONEHOT_COLS])
        vocab = {r["column"]: list(r["vocabulary"]) for r in label_vocabularies(onehot, fixed.ONEHOT_COLS).collect()}
        multi = {r["column"]: list(r["vocabulary"]) for r in label_vocabularies(df, fixed.MULTILABEL_COLS).collect()}
        vocab.update(multi)
        for c in [*fixed.ONEHOT_COLS, *fixed.MULTILABEL_COLS]:
            vocab.setdefault(c, [])
        self.vocab = vocab
        return self

    def _value_names(self, col: str) -> list[str]:
        """``col_value`` per vocabulary entry; Spark resolves names case-insensitively,
        so a later entry equal to an earlier one up to case gets a position suffix."""
        seen: set[str] = set()
        out = []
        for i, v in enumerate(self.vocab[col]):
            n = _name(col, v)
            if n.lower() in seen:
                n = f"{n}_{i}"
            seen.add(n.lower())
            out.append(n)
        return out

    def feature_names(self) -> list[str]:
        names = list(fixed.NUMERIC_COLS)
        for c in fixed.ONEHOT_COLS:
            names += self._value_names(c)
        names += list(fixed.ORDINAL_COLS)
        for c in fixed.MULTILABEL_COLS:
            names += self._value_names(c)
        return names

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Encoded columns (plus ``keep`` columns and the target when present)."""
        keep = list(keep or [])
        if "product_target" in df.columns and "product_target" not in keep:
            keep.append("product_target")
        cols = [F.col(c) for c in keep]
        cols += [F.col(c).cast("double").alias(c) for c in fixed.NUMERIC_COLS]
        for c in fixed.ONEHOT_COLS:
            cols += [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(n)
                     for v, n in zip(self.vocab[c], self._value_names(c))]
        order = F.array(*[F.lit(v) for v in fixed.ORDINAL_ORDER])
        for c in fixed.ORDINAL_COLS:
            cols.append((F.array_position(order, F.coalesce(F.col(c), F.lit(""))) - 1).cast("double").alias(c))
        for c in fixed.MULTILABEL_COLS:
            arr = F.coalesce(F.col(c), F.array().cast("array<string>"))
            cols += [F.array_contains(arr, v).cast("double").alias(n) for v, n in zip(self.vocab[c], self._value_names(c))]
        out = df.select(*cols)
        expected = len(keep) + len(self.feature_names())
        if len(out.columns) != expected:
            raise ValueError(f"encoded width {len(out.columns)} != {expected}")
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(c, i, v) for c, vs in self.vocab.items() for i, v in enumerate(vs)]
        cols = [(c, -1, None) for c, vs in self.vocab.items() if not vs]
        spark.createDataFrame(rows + cols, "column string, position int, value string").coalesce(1) \
            .write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeatureEncoder":
        vocab: dict[str, list[str]] = {}
        for r in spark.read.parquet(path).orderBy("column", "position").collect():
            vocab.setdefault(r["column"], [])
            if r["position"] >= 0:
                vocab[r["column"]].append(r["value"])
        return cls(vocab)


def ordinal_failures(encoded: DataFrame) -> DataFrame:
    """Rows whose ordinal column is unknown (-1): a quality failure, not a silent value."""
    return encoded.filter(" OR ".join(f"{c} < 0" for c in fixed.ORDINAL_COLS))
