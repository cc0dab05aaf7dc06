import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cauce.operators import models
from cauce.operators.tree_attribution import Ensemble, attributions, paths_of_nodes, shapley


def expected(nodes, at, x, known):
    """Value of a tree for a row of which only the known features are seen."""
    node = nodes[at]
    if node["left"] < 0:
        return node["prediction"]
    left, right = nodes[node["left"]], nodes[node["right"]]
    if node["feature"] in known:
        return expected(nodes, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"], x, known)
    return (left["count"] * expected(nodes, node["left"], x, known) + right["count"] * expected(nodes, node["right"], x, known)) / node["count"]


def grown(rng, features, depth):
    """A random tree as nodes in depth-first order; features repeat on a path."""
    nodes = []

    def grow(level, count):
        me = len(nodes)
        nodes.append({"id": me, "prediction": rng.uniform(-1, 1), "count": count, "left": -1, "right": -1, "feature": -1, "threshold": None})
        if level and count > 1:
            part = rng.randrange(1, count)
            left = grow(level - 1, part)
            nodes[me] |= {"feature": rng.randrange(features), "threshold": rng.choice([0.2, 0.5, 0.8]), "left": left, "right": grow(level - 1, count - part)}
        return me

    grow(depth, 64)
    return nodes


@pytest.mark.parametrize("seed", range(6))
def test_equals_the_sum_over_feature_subsets(seed):
    rng, n = random.Random(seed), 4
    nodes = grown(rng, n, 5)
    e = paths_of_nodes(nodes, 0.5)
    rows = [[rng.choice([0.1, 0.2, 0.4, 0.6, 0.9, math.nan]) for _ in range(n)] for _ in range(12)]
    got = shapley(e, np.array(rows))
    for x, phi in zip(rows, got):
        v = {s: 0.5 * expected(nodes, 0, x, s) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        assert e.base == pytest.approx(v[()])
        for i in range(n):
            want = sum(math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n) * (v[tuple(sorted((*s, i)))] - v[s]) for s in v if i not in s)
            assert phi[i] == pytest.approx(want, abs=1e-12)
        assert e.base + phi.sum() == pytest.approx(v[tuple(range(n))])


def test_bare_root():
    e = paths_of_nodes([{"id": 0, "prediction": 3.0, "count": 5, "left": -1, "right": -1}])
    assert e.base == 3.0 and shapley(e, np.ones((2, 3))).tolist() == [[0.0] * 3] * 2
    assert isinstance(e, Ensemble)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random(), rng.randrange(3) / 2, float(rng.random() < 0.1)) for i in range(900)]
    rows = [(*r, int(r[1] + 0.4 * r[3] + 0.3 * rng.random() > 0.9)) for r in rows]
    df = spark.createDataFrame(rows, "member_id long, a double, b double, c double, d double, y int")
    return df, models.train_gbt(df, "y", ["a", "b", "c", "d"], max_iter=6)


def test_phi_and_base_give_the_margin(spark, fitted):
    df, model = fitted
    features = ["a", "b", "c", "d"]
    wide = df.unionByName(spark.createDataFrame([(10_000, float("nan"), 0.1, 0.5, 0.0, 0), (10_000, 0.2, 0.1, 0.5, 0.0, 0)], df.schema))
    phi = attributions(wide, model, features, "member_id")
    assert phi.columns == ["member_id", "feature", "value", "phi", "base"]
    sums = {r["member_id"]: r["s"] + r["b"] for r in phi.where("member_id < 10000").groupBy("member_id").agg(F.sum("phi").alias("s"), F.first("base").alias("b")).collect()}
    margin = model.transform(models.assemble(df, features)).select("member_id", vector_to_array("rawPrediction")[1].alias("m"))
    for r in margin.collect():
        assert sums[r["member_id"]] == pytest.approx(r["m"], abs=1e-9)
    values = {(r["member_id"], r["feature"]): r["value"] for r in phi.collect()}
    assert values[5, "a"] == df.where("member_id = 5").first()["a"]
    assert phi.where("member_id = 10000").count() == 8 and phi.where("member_id = 10000 and value is null").count() == 1
    assert attributions(df.limit(0), model, features, "member_id").count() == 0


def test_summaries_of_tree_attributions(spark, fitted):
    df, model = fitted
    phi = attributions(df, model, ["a", "b", "c", "d"], "member_id")
    lead = [r["feature"] for r in models.global_importance(phi).collect()]
    assert lead[0] == "a" and set(lead[:2]) == {"a", "c"}  # the planted drivers lead
    drivers = models.top_positive_drivers(phi, "member_id")
    assert drivers.count() == 900
    for r in drivers.limit(50).collect():
        found = [d["phi"] for d in r["drivers"]]
        assert len(found) <= 3 and all(x > 0 for x in found) and found == sorted(found, reverse=True)
