import pytest
from pyspark.sql import functions as F

from cauce import fixed
from cauce.operators import models, nbo, quality


def test_members_without_positive_driver_stay(spark):
    rows = [("a", f, 1.0, p) for f, p in (("x", 0.5), ("y", 0.7), ("z", 0.5), ("u", 0.1), ("v", -1.0))] + [("b", "x", 2.0, -0.1), ("b", "y", 2.0, 0.0), ("c", "x", 3.0, None)]
    phi = spark.createDataFrame(rows, "member_id string, feature string, value double, phi double")
    found = {r["member_id"]: [tuple(d) for d in r["drivers"]] for r in models.top_positive_drivers(phi, "member_id").collect()}
    assert found == {"a": [(1, "y", 1.0, 0.7), (2, "x", 1.0, 0.5), (3, "z", 1.0, 0.5)], "b": [], "c": []}


def test_contract_columns_only_and_missing_refused(spark):
    every = fixed.NUMERICAL_FEATURES + fixed.CATEGORICAL_FEATURES
    row = [*(float(k) for k in range(25)), *"abcdef"]
    frame = spark.createDataFrame([("m", "Female", 1, *row)], "member_id string, gender string, tomo_mujer int, " + ", ".join(f"{c} double" for c in fixed.NUMERICAL_FEATURES) + ", " + ", ".join(f"{c} string" for c in fixed.CATEGORICAL_FEATURES))
    shuffled = frame.select(*reversed(frame.columns))
    assert quality.model_input(shuffled).columns == ["member_id", *every]
    with pytest.raises(ValueError, match="income, city"):
        quality.model_input(frame.drop("income", "city"))


def test_rejected_input_names_the_features(spark):
    nan = float("nan")
    frame = spark.createDataFrame([("a", 1.0, 2.0, "x"), ("b", None, nan, None), ("c", nan, 1.0, "x"), ("d", 1.0, 1.0, "z")], "member_id string, p double, q double, r string")
    got = {r["member_id"]: (r["missing"], r["unknown"]) for r in quality.rejected_input(frame, {"r": ["x"]}, numeric=["p", "q"]).collect()}
    assert got == {"b": (["p", "q"], ["r"]), "c": (["p"], []), "d": ([], ["r"])}


def test_season_of_a_product_without_current_rows(spark):
    monthly = spark.createDataFrame([("p", 1, 10), ("p", 2, 13), ("q", 2, 5), ("r", 1, 9), ("r", 3, 9)], "product_id string, month int, n long")
    got = {r["product_id"]: (r["top_month"], r["top_n"], r["current_n"], r["ratio"], r["applies"]) for r in nbo.seasonal_products(monthly, F.lit(1)).collect()}
    assert got == {"p": (2, 13, 10, 1.3, True), "q": (2, 5, 0, None, True), "r": (1, 9, 9, 1.0, False)}
