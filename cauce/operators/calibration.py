"""Calibrators of many models as one table, applied by a search inside an array.

A calibrator is a row: model, its score boundaries in rising order and the
values there. Applying them is an equi-join on the model, so neither a range
join nor a pivot is needed, and a binary search in an array expression.
"""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of calibrators that may go to every task; larger tables are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def fit_calibrators(scored: DataFrame, product: str = "product_id", raw: str = "raw", label: str = "y") -> DataFrame:
    """(product, boundaries, predictions) of an isotonic fit per product.

    Each is fitted on distinct scores, weighted by their rows. Rows with a null
    product, score or label, and NaN scores, take no part; a product without
    any row gets no calibrator.
    """
    spark: SparkSession = scored.sparkSession
    whole = scored.where(F.col(product).isNotNull() & F.col(raw).isNotNull() & ~F.isnan(F.col(raw).cast("double")) & F.col(label).isNotNull())
    points = whole.groupBy(F.col(product).alias("product"), F.col(raw).cast("double").alias("score")).agg(F.avg(F.col(label).cast("double")).alias("rate"), F.count(F.lit(1)).cast("double").alias("weight"))
    points = points.persist()
    rows = []
    for r in points.select("product").distinct().collect():  # one row per model
        model = IsotonicRegression(featuresCol="score", labelCol="rate", weightCol="weight").fit(points.where(F.col("product") == r["product"]))
        rows.append((r["product"], [float(x) for x in model.boundaries], [float(x) for x in model.predictions]))
    points.unpersist()
    return spark.createDataFrame(rows, f"{product} string, boundaries array<double>, predictions array<double>")


def at_most(boundaries: Column, x: Column) -> Column:
    """How many of the rising ``boundaries`` are at most ``x``, by halving: the
    array expression takes as many steps as its length has binary digits."""
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(boundaries))).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(boundaries).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        right = F.get(boundaries, middle) <= x
        done = s["low"] >= s["high"]
        return F.struct(F.when(done | ~right, s["low"]).otherwise(middle + 1).alias("low"), F.when(done | right, s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, start, halve, lambda s: s["low"])


def apply_calibrators(scores: DataFrame, calibrators: DataFrame, product: str = "product_id", raw: str = "raw") -> DataFrame:
    """All columns of ``scores`` and ``calibrated``.

    Below the first and above the last boundary the end value holds, between two
    the values are joined by a line, and the result stays in 0 to 1. A product
    without calibrator (none, or no boundaries) keeps its raw score; a null or
    NaN score stays as it is. Calibrators of a checked size are broadcast.
    """
    size = calibrators.agg(F.coalesce(F.sum(F.size("boundaries") * 16), F.lit(0))).first()[0]
    held = calibrators.select(F.col(product).alias("__p"), F.col("boundaries").alias("__b"), F.col("predictions").alias("__v")).where(F.size("__b") > 0)
    x = F.col(raw).cast("double")
    joined = scores.join(F.broadcast(held) if size <= BROADCAST_BYTES else held, F.col(product) == F.col("__p"), "left")
    joined = joined.withColumn("__k", at_most(F.col("__b"), x))
    at = lambda c, k: F.get(c, k)
    k, b, v = F.col("__k"), F.col("__b"), F.col("__v")
    low, high = at(b, k - 1), at(b, k)
    between = at(v, k - 1) + (at(v, k) - at(v, k - 1)) * (x - low) / (high - low)
    value = F.when(k == 0, at(v, F.lit(0))).when((k == F.size(b)) | (low == x), at(v, k - 1)).otherwise(between)
    value = F.when(b.isNull() | x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))
    return joined.withColumn("calibrated", value).drop("__p", "__b", "__v", "__k")
