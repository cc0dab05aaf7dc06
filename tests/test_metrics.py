import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window

from cauce.operators import metrics
from cauce.operators.ordering import cumulative_sums, global_row_number, row_number_in_group


def _fixture(spark, n=500, seed=7):
    rnd = random.Random(seed)
    rows = [(i, int(rnd.random() < 0.3), rnd.randint(0, 20) / 20.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, y int, p double")


def _brute_auc(rows):
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    s = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def _brute_ks(rows):
    scores = sorted({p for _, _, p in rows})
    P = sum(y for _, y, _ in rows)
    N = len(rows) - P
    best = 0.0
    for s in scores:
        tp = sum(1 for _, y, p in rows if y == 1 and p <= s)
        fp = sum(1 for _, y, p in rows if y == 0 and p <= s)
        best = max(best, abs(tp / P - fp / N))
    return best


def test_auc_ks_tie_aware(spark):
    rows, df = _fixture(spark)
    r = metrics.ranking_summary(df).collect()[0]
    assert abs(r["test_auc"] - _brute_auc(rows)) < 1e-12
    assert abs(r["test_ks"] - _brute_ks(rows)) < 1e-12
    assert abs(r["test_gini"] - (2 * r["test_auc"] - 1)) < 1e-12


def test_ks_one_class_is_zero(spark):
    df = spark.createDataFrame([(i, 0, i / 10) for i in range(10)], "id long, y int, p double")
    assert metrics.ranking_summary(df).collect()[0]["test_ks"] == 0.0


def test_quantile_edges_match_numpy(spark):
    rows, df = _fixture(spark)
    probs = [i / 10 for i in range(11)]
    got = {r["q"]: r["edge"] for r in metrics.quantile_edges(df, "p", probs).collect()}
    want = np.quantile(np.array([p for _, _, p in rows]), probs)
    for q, w in zip(probs, want):
        assert abs(got[q] - w) < 1e-12


def test_lift_counts_sum(spark):
    rows, df = _fixture(spark)
    lt = metrics.lift_table(df).collect()
    assert sum(r["count"] for r in lt) == len(rows)
    assert sorted(r["decile"] for r in lt) == list(range(len(lt)))


def test_global_row_number_matches_window(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = {r["id"]: r["rn"] for r in global_row_number(df, [F.col("v").desc(), F.col("id")]).collect()}
    want = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("v").desc(), "id"))).collect()}
    assert got == want
    got_g = {r["id"]: r["rn"] for r in row_number_in_group(df, ["g"], ["v", "id"]).collect()}
    want_g = {r["id"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).collect()}
    assert got_g == want_g


def test_cumulative_sums(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(1000)], "k long, x long")
    got = {r["k"]: r["x_cum"] for r in cumulative_sums(df, "k", ["x"]).collect()}
    run = 0
    for k in range(1000):
        run += k % 5
        assert got[k] == run


def test_fairness_top_k(spark):
    rows, df = _fixture(spark)
    df = df.withColumn("g", (F.col("id") % 2 == 0))
    out = {r["group_name"]: r for r in metrics.fairness_audit(df, {"even": "g", "odd": "NOT g"}, id_col="id").collect()}
    top = sorted(rows, key=lambda r: (-r[2], r[0]))[: int(len(rows) * 0.2)]
    even = [r for r in top if r[0] % 2 == 0]
    assert out["even"]["group_selected"] == len(even)
    assert abs(out["even"]["group_selection_rate"] - sum(r[1] for r in even) / len(even)) < 1e-12
