"""Exact path-dependent attributions of a boosted tree ensemble.

The nodes of an MLlib tree ensemble become root-to-leaf paths. On a path, each
distinct feature has one interval of values and one share of the training rows
that follow the path at its splits. For a leaf, a row matters only by which of
the path's features lie inside their intervals, so the Shapley values of each
such pattern are tabulated once; scoring a batch is one comparison a feature
and one table look-up a path. What goes to the tasks is bounded by trees times
leaves, never by rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce.session import shared_path


@dataclass(frozen=True)
class Path:
    """One leaf: its features, open lower and closed upper ends, and ``phi``:
    attribution by pattern (bit k set: feature k is inside) and feature."""
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    phi: np.ndarray


@dataclass(frozen=True)
class Ensemble:
    paths: list[Path]
    base: float


def leaf_table(value: float, shares: list[float]) -> np.ndarray:
    """Shapley values of the game that pays ``value`` times, for every feature,
    1 or 0 (inside or not) when it is known and its share when it is not."""
    n = len(shares)
    weight = [math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) for k in range(n)]
    out = np.zeros((1 << n, n))
    for pattern in range(1 << n):
        inside = [pattern >> k & 1 for k in range(n)]
        for i in range(n):
            # by size of the known set: products over the other features
            sums = [1.0]
            for j in range(n):
                if j != i:
                    sums = [shares[j] * a + inside[j] * b for a, b in zip([*sums, 0.0], [0.0, *sums])]
            out[pattern, i] = value * (inside[i] - shares[i]) * sum(w * s for w, s in zip(weight, sums))
    return out


def paths_of_nodes(nodes: list[dict], weight: float = 1.0) -> Ensemble:
    """Paths of one tree from its nodes: id, prediction, count (training rows),
    left and right (child ids, -1 at a leaf), feature, threshold (left: at most)."""
    by_id = {n["id"]: n for n in nodes}
    paths, base = [], 0.0

    def walk(node: dict, ends: dict[int, tuple[float, float]], share: dict[int, float]) -> None:
        nonlocal base
        if node["left"] < 0:
            value, shares = weight * node["prediction"], list(share.values())
            base += value * math.prod(shares)
            if share:
                paths.append(Path(tuple(share), tuple(ends[f][0] for f in share), tuple(ends[f][1] for f in share), leaf_table(value, shares)))
            return
        f = node["feature"]
        low, high = ends.get(f, (-math.inf, math.inf))
        for child, side in ((by_id[node["left"]], (low, min(high, node["threshold"]))), (by_id[node["right"]], (max(low, node["threshold"]), high))):
            part = child["count"] / node["count"] if node["count"] else 0.5
            walk(child, {**ends, f: side}, {**share, f: share.get(f, 1.0) * part})

    walk(by_id[0], {}, {})
    return Ensemble(paths, base)


def ensemble_of(model, spark: SparkSession) -> Ensemble:
    """Paths of a fitted tree ensemble, read from its written form. The margin of
    a boosted classifier is the weighted sum of its trees' predictions."""
    folder = shared_path(spark, f"tree-model-{uuid.uuid4().hex}")
    model.write().save(folder)
    data = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    if data.where("split.numCategories >= 0").take(1):
        raise ValueError("attributions need splits on numbers, this ensemble has some on categories")
    split = F.col("split")
    rows = data.select("treeID", "id", "prediction", F.col("rawCount").cast("double").alias("count"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                       split["featureIndex"].alias("feature"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold")).collect()
    trees: dict[int, list[dict]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], []).append(r.asDict())
    parts = [paths_of_nodes(trees[k], w) for k, w in enumerate(model.treeWeights)]
    return Ensemble([p for e in parts for p in e.paths], sum(e.base for e in parts))


def shapley(ensemble: Ensemble, x: np.ndarray) -> np.ndarray:
    """Attribution of every feature of every row. A missing number (NaN) takes
    the right branch of each split, as the trees do."""
    out = np.zeros(x.shape)
    for p in ensemble.paths:
        pattern = np.zeros(len(x), np.int64)
        for k, (f, low, high) in enumerate(zip(p.features, p.low, p.high)):
            inside = ~(x[:, f] <= low) & ((x[:, f] <= high) | (high == math.inf))
            pattern |= inside.astype(np.int64) << k
        # a path's features are distinct, so one indexed addition takes them all
        out[:, list(p.features)] += p.phi[pattern]
    return out


def attributions(df: DataFrame, model, features: list[str], key: str) -> DataFrame:
    """(key, feature, value, phi, base): one row per member and feature.

    ``value`` is the feature's own value (null where missing). A member's phi
    and the base add up to the model's margin. Repeated members count each, an
    empty frame gives no rows; a model of bare roots gives phi 0.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(ensemble_of(model, spark))
    source = df.select(F.col(key), *(F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)))
    schema = T.StructType([source.schema[0], T.StructField("phi", T.ArrayType(T.DoubleType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
    n = len(features)

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False).astype(float) for k in range(n)]) if batch.num_rows else np.zeros((0, n))
            offsets = pa.array(np.arange(len(x) + 1) * n, pa.int32())
            phi, values = shapley(held.value, x).ravel(), x.ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(phi)),
                                              pa.ListArray.from_arrays(offsets, pa.array(values, mask=np.isnan(values)))], [key, "phi", "values"])

    names = F.array(*map(F.lit, features))
    long = F.arrays_zip(names.alias("feature"), F.col("values").alias("value"), F.col("phi"))
    rows = source.mapInArrow(run, schema).select(key, F.explode(long).alias("__r"))
    return rows.select(key, F.col("__r")["feature"].alias("feature"), F.col("__r")["value"].alias("value"), F.col("__r")["phi"].alias("phi"), F.lit(held.value.base).alias("base"))
