"""Model training, calibration, scoring and attributions with MLlib.

Boosted trees (GBTClassifier) and a WoE scorecard (quantile bins + WoE table
+ LogisticRegression) train on one shared split; isotonic regression
calibrates on the validation part; scoring is a ``transform`` per model on
one assembled vector, producing a long (member, model, raw, calibrated)
table. Scorecard attributions are exact column expressions
(beta_j * (woe_j - mean woe_j)); their summaries are ordinary aggregates.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cauce import fixed
from cauce.operators.metrics import quantile_edges


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def train_gbt(train: DataFrame, label: str, features: list[str], max_iter: int = 30, seed: int = fixed.SPLIT_SEED):
    """Gradient-boosted trees (depth 4, step 0.1, at least 20 rows per leaf)."""
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=4, stepSize=0.1,
                        minInstancesPerNode=20, seed=seed, predictionCol="gbt_prediction")
    return gbt.fit(assemble(train, features))


def score_gbt(model, df: DataFrame, features: list[str], out: str = "raw_score") -> DataFrame:
    scored = model.transform(assemble(df, features))
    return scored.withColumn(out, vector_to_array(F.col("probability"))[1]).drop(
        "features", "gbt_prediction", "probability", "rawPrediction")


def fit_isotonic(valid_scored: DataFrame, label: str, raw: str = "raw_score"):
    """Isotonic (increasing) calibrator fitted on validation scores."""
    iso = IsotonicRegression(isotonic=True, featuresCol=raw, labelCol=label, predictionCol="calibrated")
    return iso.fit(valid_scored.select(F.col(raw), F.col(label).cast("double").alias(label)))


def apply_isotonic(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    return out.withColumn("calibrated", F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)))


def _inner_edges(long: DataFrame, n_bins: int) -> DataFrame:
    """(feature, edge) interior quantile edges, duplicates dropped (small: features x bins)."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    edges = quantile_edges(long, "value", probs, group=["feature"]).select("feature", "edge").distinct()
    rng = edges.groupBy("feature").agg(F.min("edge").alias("__lo"), F.max("edge").alias("__hi"))
    return (edges.join(rng, "feature").filter((F.col("edge") > F.col("__lo")) & (F.col("edge") < F.col("__hi")))
            .select("feature", "edge"))


def _bin(long: DataFrame, inner: DataFrame) -> DataFrame:
    """bin = number of interior edges strictly below the value (right-closed bins)."""
    e = inner.withColumnRenamed("feature", "__f")
    j = long.join(F.broadcast(e), (F.col("feature") == F.col("__f")) & (F.col("value") > F.col("edge")), "left")
    keys = [c for c in long.columns]
    return j.groupBy(*keys).agg(F.count("edge").alias("bin"))


def _long(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])))


def woe_table(df: DataFrame, label: str, features: list[str], n_bins: int = 10, smoothing: float = 0.5,
              inner: DataFrame | None = None) -> DataFrame:
    """WoE and information value per (feature, bin) plus the bin's upper edge.

    Bins: exact quantile edges per feature (duplicates dropped, right-closed);
    WoE = ln(((bad + s) / B) / ((good + s) / G)). Distinct (feature, value)
    pairs are binned with a broadcast range join to the small edge table.
    """
    long = _long(df, features, [F.col(label).alias("__y")])
    inner = inner if inner is not None else _inner_edges(long, n_bins)
    dist = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("__y").alias("bad"))
    binned = _bin(dist, inner)
    per = binned.groupBy("feature", "bin").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    per = per.withColumn("good", F.col("n") - F.col("bad"))
    tot = per.groupBy("feature").agg(F.sum("bad").alias("__B"), F.sum("good").alias("__G"))
    j = per.join(tot, "feature")
    woe = F.log(((F.col("bad") + smoothing) / F.col("__B")) / ((F.col("good") + smoothing) / F.col("__G")))
    return j.select("feature", "bin", "min_value", "max_value", "n", "bad", "good", woe.alias("woe"),
                    ((F.col("bad") / F.col("__B") - F.col("good") / F.col("__G")) * woe).alias("iv_part"))


def information_value(table: DataFrame) -> DataFrame:
    return table.groupBy("feature").agg(F.sum("iv_part").alias("iv"))


def apply_woe(df: DataFrame, fit_df: DataFrame, label: str, features: list[str], key: str, n_bins: int = 10) -> DataFrame:
    """WoE-encoded frame (key + one WoE column per feature); bins fitted on ``fit_df``."""
    fit_long = _long(fit_df, features, [F.col(label).alias("__y")])
    inner = _inner_edges(fit_long, n_bins)
    table = woe_table(fit_df, label, features, n_bins, inner=inner).select("feature", "bin", "woe")
    binned = _bin(_long(df, features, [key]), inner)
    j = binned.join(F.broadcast(table), ["feature", "bin"], "left")
    return j.groupBy(key).pivot("feature", features).agg(F.first("woe"))


def train_scorecard(woe_frame: DataFrame, label: str, features: list[str]):
    lr = LogisticRegression(labelCol=label, featuresCol="features", maxIter=1000, predictionCol="lr_prediction")
    return lr.fit(assemble(woe_frame.fillna(0.0, subset=features), features))


def scorecard_attributions(woe_frame: DataFrame, model, features: list[str], key: str) -> DataFrame:
    """Exact scorecard attributions phi_j = beta_j * (woe_j - mean woe_j), long form."""
    beta = list(model.coefficients)
    means = woe_frame.agg(*[F.avg(c).alias(c) for c in features]).first()
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"),
                              (F.lit(beta[i]) * (F.col(c) - F.lit(means[c] or 0.0))).alias("phi"))
                     for i, c in enumerate(features)])
    return woe_frame.select(key, F.inline(rows))


def global_importance(phi: DataFrame) -> DataFrame:
    """Mean |phi| per feature, descending."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")).orderBy(F.col("mean_abs_phi").desc())


def top_positive_drivers(phi: DataFrame, key: str, k: int = 3) -> DataFrame:
    """Top-k positive contributions per member, none for a member without one (a member has one row per feature)."""
    held = F.collect_list(F.struct((-F.col("phi")).alias("order"), "feature", "value", "phi"))
    top = F.slice(F.array_sort(F.filter(held, lambda d: d["phi"] > 0)), 1, k)
    ranked = F.transform(top, lambda d, i: F.struct((i + 1).alias("rank"), d["feature"].alias("feature"), d["value"].alias("value"), d["phi"].alias("phi")))
    return phi.groupBy(key).agg(ranked.alias("drivers"))


def select_model(auc_gbt: float, auc_woe: float, margin: float = 0.005) -> str:
    """Boosted trees only when they beat the scorecard by the margin on validation."""
    if auc_gbt is None or (isinstance(auc_gbt, float) and math.isnan(auc_gbt)):
        return "woe"
    return "gbt" if auc_gbt - auc_woe >= margin else "woe"
