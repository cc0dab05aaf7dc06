import bisect
import random

import pytest
from pyspark.sql import functions as F

from cauce.operators.calibration import apply_calibrators, at_most, fit_calibrators


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 7, 8, 9, 31, 32, 33])
def test_search(spark, n):
    b = [float(2 * k) for k in range(n)]
    rows = spark.createDataFrame([(b, x / 2) for x in range(-3, 4 * n + 3)], "b array<double>, x double")
    for r in rows.withColumn("k", at_most(F.col("b"), F.col("x"))).collect():
        assert r["k"] == bisect.bisect_right(b, r["x"])


def test_lines_ends_and_missing_calibrators(spark):
    held = spark.createDataFrame([("p", [0.2, 0.4, 0.4, 0.8], [0.1, 0.3, 0.3, 1.2]), ("empty", [], [])], "product_id string, boundaries array<double>, predictions array<double>")
    nan = float("nan")
    rows = [("p", 0.0), ("p", 0.2), ("p", 0.3), ("p", 0.4), ("p", 0.6), ("p", 0.9), ("p", None), ("p", nan), ("q", 0.7), ("empty", 0.6), (None, 0.5), ("p", 0.3)]
    scores = spark.createDataFrame([(i, p, x, 1) for i, (p, x) in enumerate(rows)], "member_id long, product_id string, raw double, boundaries int")
    out = apply_calibrators(scores, held)
    assert out.columns == [*scores.columns, "calibrated"]
    got = [r["calibrated"] for r in out.orderBy("member_id").collect()]
    assert got[6] is None and got[7] != got[7]
    want = [0.1, 0.1, 0.2, 0.3, 0.75, 1.0, None, None, 0.7, 0.6, 0.5, 0.2]
    assert [g for k, g in enumerate(got) if k not in (6, 7)] == pytest.approx([w for k, w in enumerate(want) if k not in (6, 7)])
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert apply_calibrators(scores.limit(0), held).count() == 0
    assert [r["calibrated"] for r in apply_calibrators(scores, held.limit(0)).where("product_id = 'p' and raw = 0.3").collect()] == [0.3, 0.3]


def test_fit_is_the_isotonic_minimum(spark):
    rng = random.Random(2)
    rows = [(p, rng.randrange(12) / 12, int(rng.random() < q)) for p, q in (("a", 0.3), ("b", 0.6)) for _ in range(200)]
    bad = [("a", None, 1), ("a", float("nan"), 1), (None, 0.5, 1), ("none", 0.5, None)]
    held = fit_calibrators(spark.createDataFrame(rows + bad, "product_id string, raw double, y int"))
    assert {r["product_id"] for r in held.collect()} == {"a", "b"}
    scores = spark.createDataFrame([(p, x) for p, x, _ in rows], "product_id string, raw double").distinct()
    for r in apply_calibrators(scores, held).collect():
        mine = sorted((x, y) for p, x, y in rows if p == r["product_id"])
        xs = sorted({x for x, _ in mine})
        mean = lambda a, b: (lambda y: sum(y) / len(y))([y for x, y in mine if a <= x <= b])
        want = max(min(mean(a, b) for b in xs if b >= r["raw"]) for a in xs if a <= r["raw"])
        assert r["calibrated"] == pytest.approx(want)
