from pyspark.sql import functions as F

from cauce.functions import money
from cauce.operators import reasons

DRIVERS = "member_id string, drivers array<struct<rank int, feature string, value double, phi double>>"


def test_driver_phrases_in_order(spark):
    rows = [("none", []), ("null", None), ("one", [(1, "income", 2.0, 0.3)]),
            ("two", [(1, "dependents", 2.0, 0.3), (2, "new_feature", 1.0, 0.2)]),
            ("three", [(1, "age", None, 0.3), (2, "job_tenure_months", float("nan"), 0.2), (3, "n_orders", 3.0, 0.1)])]
    out = spark.createDataFrame(rows, DRIVERS).select("member_id", reasons.driver_reason(F.col("drivers")).alias("r"))
    assert {r["member_id"]: r["r"] for r in out.collect()} == {
        "none": None, "null": None, "one": "tus ingresos", "two": "2 personas a cargo y new feature",
        "three": "tu edad, tus meses en el empleo y 3 compras con nosotros"}


def test_sentence_with_and_without_drivers(spark):
    schema = "member_id string, primary_product string, instalment bigint, channel string, contact_window string, timing string"
    decisions = spark.createDataFrame([("a", "libre_inversion", 125400, "app", "night", "inmediato"), ("b", None, None, "sms", "night", None),
                                       ("c", "vivienda", 1000, "sms", None, "seasonality")], schema)
    drivers = spark.createDataFrame([("a", [(1, "age", 30.0, 0.3)])], DRIVERS)
    out = {r["member_id"]: r["reason"] for r in reasons.with_reasons(decisions, drivers).collect()}
    assert out["a"] == ("Te recomendamos libre inversion por tu edad (30 años); la cuota mensual de $125.000 no supera el 30% de tu ingreso disponible; "
                        "te contactamos por la app en la noche, de inmediato.")
    assert out["b"] is None
    assert out["c"] == "Te recomendamos vivienda; la cuota mensual de $1.000 no supera el 30% de tu ingreso disponible; te contactamos por SMS, por la temporada."
    assert {r["member_id"]: r["reason"] for r in reasons.with_reasons(decisions).collect()}["a"].startswith("Te recomendamos libre inversion; la cuota")
    assert reasons.with_reasons(decisions.limit(0)).collect() == []


def test_wage_tiers_at_their_bounds(spark):
    wage = 1423500.0
    rows = [(0.0, 1.0, "A"), (wage, 1.0, "A"), (2 * wage, 2.0, "A"), (2 * wage + 1, None, "B"), (4 * wage, 4.0, "B"), (5 * wage, 5.0, "C"), (90 * wage, 25.0, "C"),
            (None, None, None), (float("nan"), None, None)]
    out = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, income double").select("k", money.income_in_wages(F.col("income")).alias("w"), money.wage_tier(F.col("income")).alias("t"))
    for r in out.collect():
        _, wages, tier = rows[r["k"]]
        assert r["t"] == tier
        assert wages is None or r["w"] == wages
        assert (r["w"] is None) == (tier is None)
