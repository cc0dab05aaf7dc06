from pyspark.sql import functions as F

from cauce.operators.campaign import batch_report, person_results
from cauce.operators.messages import compose_messages
from cauce.operators.offers import evaluate_offers
from conftest import personas_rows


def _cop(v):
    return "$" + f"{int(round(v / 1000.0) * 1000):,}".replace(",", ".")


def _expected_amount(ingresos, cap, rate):
    max_cuota = ingresos * 0.30 * (cap / 100.0)
    i = (1 + rate) ** (1 / 12) - 1
    amount = max_cuota * (1 - (1 + i) ** -36) / i
    cuota = amount * i / (1 - (1 + i) ** -36)
    return _cop(amount), _cop(cuota)


def test_personas_golden(spark, personas):
    offers = {r["person_id"]: r for r in evaluate_offers(personas).collect()}
    assert sum(1 for r in offers.values() if r["outcome"] == "offer") == 11
    assert offers["10000006"]["outcome"] == "no_offer"
    a = offers["10000001"]
    assert (a["product_id"], a["channel"], a["contact_window"], a["trigger"]) == ("educativo", "whatsapp", "night", "inicio_semestre")
    b = offers["10000002"]
    assert (b["product_id"], b["channel"], b["contact_window"], b["trigger"]) == ("compra_cartera", "email", "morning", "inmediato")
    assert offers["10000003"]["product_id"] == "hipotecario"
    assert offers["10000004"]["product_id"] == "libre_inversion"
    assert offers["P0003"]["channel"] == "app"
    rates = {"A": 0.145, "B": 0.165, "C": 0.185}
    for row in personas_rows():
        ced, ingresos, cat, cap = row[0], row[3], row[4], row[7]
        if ced == "10000006":
            continue
        amount, cuota = _expected_amount(ingresos, cap, rates[cat])
        assert offers[ced]["amount_cop"] == amount and offers[ced]["cuota_cop"] == cuota
    assert offers["10000001"]["annual_rate_pct"] == "14,5% E.A."
    assert offers["10000005"]["reason"].endswith("por tus intereses en educacion, tecnologia y tu capacidad de pago disponible del 60%.")


def test_campaign_counts_and_not_found(spark, personas):
    ids = [(r[0],) for r in personas_rows()] + [("99999999",), ("P9999",)]
    up = spark.createDataFrame([("b1", i, c) for i, (c,) in enumerate(ids)], "batch_id string, pos long, person_id string")
    rep = batch_report(person_results(up, personas)).collect()[0]
    assert (rep["total"], rep["processed"], rep["no_offer"], rep["errors"], rep["person_not_found"]) == (14, 11, 1, 0, 2)


def test_template_blank_name(spark, personas):
    p = personas.withColumn("nombre", F.when(F.col("cedula") == "10000001", F.lit("   ")).otherwise(F.col("nombre")))
    msgs = {r["person_id"]: r["message_text"] for r in compose_messages(evaluate_offers(p)).collect()}
    assert msgs["10000001"].startswith("Hola, tenemos una oferta de Crédito Educativo para ti: monto $")
    assert msgs["10000002"].startswith("Hola Carlos Ruiz, tenemos una oferta de Compra de Cartera")


def test_generated_text_fallback(spark, personas):
    offers = evaluate_offers(personas)
    gen = spark.createDataFrame([("10000001", "Texto generado"), ("10000002", "   "), ("P0003", "no aplica")],
                                "person_id string, text string")
    m = {r["person_id"]: (r["message_source"], r["message_text"]) for r in compose_messages(offers, gen).collect()}
    assert m["10000001"] == ("llm", "Texto generado")
    assert m["10000002"][0] == "template"       # blank generated text
    assert m["P0003"][0] == "template"          # app channel never uses generated text
