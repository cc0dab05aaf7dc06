"""Logical credit tables bound to the driver's tables.

There are no member, interaction or score tables in the test data, so each
logical table is a deterministic projection of a driver table (integer
arithmetic only, so that any engine reproduces it bit for bit). All of them
are narrow projections: no shuffle except where an aggregate of ``orders``
is needed, and that one is a partial (map-side combined) aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cauce import fixed
from cauce.sources.tables import read_table

CEDULA_BASE = 100000000


def _pick(key: Column, modulus: int, values: list) -> Column:
    """``values[key % modulus]`` as a CASE expression (values may be arrays or null)."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(None) if v is None else (F.array(*[F.lit(x) for x in v]) if isinstance(v, list) else F.lit(v))
        expr = F.when(key % modulus == i, lit) if expr is None else expr.when(key % modulus == i, lit)
    return expr


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``persons`` (member profile) from ``customer``; one row per customer."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    k = F.col("c_custkey")
    ingresos_int = F.lit(1400000) + (k * 7919 % 9000) * 1000
    seg = F.col("c_mktsegment")
    return c.select(
        (F.lit(CEDULA_BASE) + k).cast("string").alias("cedula"),
        F.col("c_name").alias("nombre"),
        F.when(k % 11 == 5, F.lit("")).when(k % 11 != 0, F.concat(F.lit("cliente"), k.cast("string"), F.lit("@example.com"))).alias("correo"),
        F.concat(F.lit("Calle "), (k % 100).cast("string")).alias("direccion"),
        F.when(k % 7 != 0, F.concat(F.lit("573"), F.lpad(k.cast("string"), 9, "0"))).alias("telefono"),
        (k % 100 < 62).alias("consent_whatsapp"),
        (k % 25 < 12).alias("consent_email"),
        (F.lit(18) + k * 31 % 52).cast("int").alias("edad"),
        ingresos_int.cast("double").alias("ingresos"),
        (F.lit(150) + k * 17 % 801).cast("int").alias("score_datacredito"),
        (k % 5).cast("int").alias("num_creditos_activos"),
        (ingresos_int * 2).cast("double").alias("deuda_total_acumulada_cop"),
        (ingresos_int * 15 / 100).cast("double").alias("cuota_mensual_total_cop"),
        (F.lit(5) + k * 13 % 91).cast("double").alias("capacidad_endeudamiento_disponible_pct"),
        F.when(ingresos_int <= 2 * fixed.SMMLV_COP, "A").when(ingresos_int <= 4 * fixed.SMMLV_COP, "B").otherwise("C").alias("categoria_afiliacion"),
        F.when(k % 100 < 82, "0_DIAS").when(k % 100 < 94, "30_DIAS").when(k % 100 < 97, "60_DIAS").otherwise("90_MAS_DIAS").alias("mora_maxima_historica"),
        _pick(F.col("c_nationkey"), 4, [["servicios"], ["comercio"], ["industria"], ["educacion"]]).alias("area_trabajo"),
        F.when(seg == "BUILDING", F.array(F.lit("vivienda")))
        .when(seg == "MACHINERY", F.when(k % 2 == 0, F.array(F.lit("Educacion"), F.lit("tecnologia"))).otherwise(F.array(F.lit("educacion"))))
        .when(seg == "AUTOMOBILE", F.array(F.lit("consolidacion")))
        .when(seg == "FURNITURE", F.array(F.lit("turismo"), F.lit("salud")))
        .alias("intereses"),
        F.when(F.col("c_acctbal") >= 0, F.array(F.lit("digital"))).otherwise(F.array(F.lit("presencial"))).alias("preferencias"),
        _pick(k, 5, [["inicio_semestre"], ["nacimiento_hijo", "mudanza"], [], None, ["primer_empleo"]]).alias("momentos_clave"),
        _pick(k, 3, [["pareja"], ["pareja", "hijos"], ["soltero"]]).alias("composicion_familiar"),
        _pick(k, 4, [["consumo"], ["vivienda", "consumo"], [], None]).alias("historial_creditos"),
        F.when(k % 20 < 3, F.lit(None)).otherwise(
            _pick(k, 6, ["educativo", "compra_cartera", "hipotecario", "libre_inversion", "cupo_rotativo", "turismo"])
        ).alias("product_target"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored`` (label, raw score) from ``lineitem``: 101 distinct scores, heavy ties."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_tax")
    raw_int = (F.col("l_quantity").cast("bigint") * 7 + F.round(F.col("l_discount") * 100).cast("bigint") * 13) % 101
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("score_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (raw_int / 101.0).alias("p"),
        F.col("l_linestatus").alias("grp"),
        (F.col("l_tax") >= 0.04).alias("tax_high"),
    )


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``interactions`` (member, product, channel, time, outcome) from ``events``."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    eid = F.col("event_id")
    channel = _pick(eid, 6, fixed.CHANNELS)
    product = _pick(eid, 8, [p[0] for p in fixed.PRODUCT_CATALOG])
    hour = F.hour("ts")
    return e.select(
        eid.alias("interaction_id"),
        (F.lit(CEDULA_BASE) + F.col("user_id")).cast("string").alias("member_id"),
        product.alias("product_id"),
        channel.alias("channel"),
        F.col("ts").alias("contacted_at"),
        F.when(hour < 11, "morning").when(hour < 14, "midday").when(hour < 18, "afternoon").otherwise("night").alias("contact_window"),
        F.when(F.col("event_type") == "purchase", "accepted")
        .when(F.col("event_type").isin("view", "click"), "ignored")
        .otherwise("rejected").alias("outcome"),
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-member order history: counts used as holdings and risk proxies.

    A partial aggregate on ``o_custkey`` (combined map-side before the
    shuffle), so a member with a third of all orders costs one row per
    map task, not a hot reducer.
    """
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return o.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("n_pending"),
        F.max(F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), 1).otherwise(0)).alias("has_mortgage"),
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
    )


def id_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded raw ids, one row per cell: (batch_id, pos, raw_id).

    Built from ``customer`` with injected dots, blanks, lower case, bad and
    repeated ids. Batches of 1000 consecutive keys (so batch size stays
    bounded and the number of batches grows with the data); position = key.
    """
    c = read_table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    ced = (F.lit(CEDULA_BASE) + k).cast("string")
    dotted = F.concat_ws(".", F.substring(ced, 1, 3), F.substring(ced, 4, 3), F.substring(ced, 7, 3))
    raw = (
        F.when(k % 10 == 0, dotted)
        .when(k % 10 == 1, F.concat(F.lit(" "), ced, F.lit(" ")))
        .when(k % 10 == 2, F.concat(F.lit("abc"), k.cast("string")))
        .when(k % 10 == 3, (F.lit(CEDULA_BASE) + k + 7).cast("string"))
        .when(k % 10 == 4, F.concat(F.lit("p"), F.lpad(k.cast("string"), 6, "0")))
        .when(k % 10 == 5, F.lit("12"))
        .otherwise(ced)
    )
    return c.select(
        F.concat(F.lit("batch-"), F.floor(k / 1000).cast("string")).alias("batch_id"),
        k.alias("pos"),
        raw.alias("raw_id"),
    )


def member_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model-side member features (subset of the 31-feature contract) + gender.

    Joins ``persons`` to the per-member order aggregate; the aggregate has
    one row per member, so the join is a plain equi-join on the key.
    """
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    h = holdings(spark, sf_dir)
    k = F.col("c_custkey")
    ingresos_int = F.lit(1400000) + (k * 7919 % 9000) * 1000
    seg = F.col("c_mktsegment")
    base = c.join(h, c.c_custkey == h.o_custkey, "left")
    return base.select(
        (F.lit(CEDULA_BASE) + k).cast("string").alias("member_id"),
        F.when(ingresos_int <= 2 * fixed.SMMLV_COP, "A").when(ingresos_int <= 4 * fixed.SMMLV_COP, "B").otherwise("C").alias("category"),
        (F.lit(18) + k * 31 % 52).cast("double").alias("age"),
        ingresos_int.cast("double").alias("income"),
        (k * 7 % 120).cast("double").alias("job_tenure_months"),
        _pick(k, 3, ["indefinido", "fijo", "prestacion"]).alias("contract_type"),
        ((k * 17 % 801) / 800.0).alias("internal_score"),
        ((k * 11 % 60) / 100.0).alias("debt_ratio"),
        F.when(k % 100 >= 94, 1.0).otherwise(0.0).alias("current_delinquency"),
        F.coalesce(F.col("has_mortgage"), F.lit(0)).cast("double").alias("has_mortgage"),
        (k * 29 % 101).cast("double").alias("digital_affinity"),
        (k * 3 % 36).cast("double").alias("months_since_event"),
        (k % 4).cast("double").alias("dependents"),
        F.coalesce(F.col("n_orders"), F.lit(0)).cast("double").alias("n_orders"),
        F.coalesce(F.col("n_pending"), F.lit(0)).cast("double").alias("n_pending"),
        F.when(seg == "MACHINERY", 1.0).otherwise(0.0).alias("education_interest"),
        F.when(seg == "BUILDING", 1.0).otherwise(0.0).alias("housing_interest"),
        F.when(seg == "AUTOMOBILE", 1.0).otherwise(0.0).alias("consolidation_interest"),
        F.when(k % 2 == 0, "Female").otherwise("Male").alias("gender"),
        (k % 100 < 62).alias("consent_whatsapp"),
        (k % 7 != 0).alias("has_phone"),
        (k % 25 < 12).alias("consent_email"),
        ((k % 11 != 0) & (k % 11 != 5)).alias("has_email"),
    )


def decision_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with what the decision needs: features with gaps (null and NaN
    every so many keys), timing columns, ``pd`` and ``p_accept``.

    The scores stand in for the nine models' output, in arithmetic that another
    engine repeats exactly: propensity from the member key and product
    position, PD from the member's share of pending orders.
    """
    k = F.col("member_id").cast("bigint") - CEDULA_BASE
    nan, missing = F.lit(float("nan")), F.lit(None)
    rows = F.map_from_arrays(F.array(*[F.lit(p[0]) for p in fixed.PRODUCT_CATALOG]), F.array(*[
        ((k * (2 * i + 3) + 17 * i) % 50) / 100.0 for i in range(len(fixed.PRODUCT_CATALOG))]))
    gap = lambda m, c, v: F.when(k % m == 0, v).otherwise(F.col(c))
    return member_features(spark, sf_dir).withColumns({
        "age": gap(97, "age", missing), "income": gap(89, "income", nan), "job_tenure_months": gap(83, "job_tenure_months", missing),
        "internal_score": gap(79, "internal_score", nan), "debt_ratio": gap(101, "debt_ratio", missing), "category": gap(103, "category", missing),
        "contract_type": gap(71, "contract_type", missing), "current_delinquency": gap(73, "current_delinquency", missing),
        "has_mortgage": gap(67, "has_mortgage", missing), "gender": gap(61, "gender", missing),
        "pd": F.when(k % 59 == 0, missing).otherwise((F.col("n_pending") + 1.0) / (F.col("n_orders") + 6.0) * 0.5),
        "p_accept": rows, "tenure_months": (k * 19 % 40).cast("double"), "active_credit": (k % 3).cast("double"),
        "months_since_last_credit": (k * 5 % 48).cast("double"),
    })


def contract_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member id and all 31 features of the model contract, some null or NaN."""
    m = member_features(spark, sf_dir)
    k = F.col("member_id").cast("bigint") - CEDULA_BASE
    number = lambda c: c.cast("double")
    flag = lambda n, r: F.when(k % n == r, 1.0).otherwise(0.0)
    more = {
        "tenure_months": F.when(k % 53 != 0, number(k * 19 % 40)), "subsidy_usage_12m": number(k * 23 % 13),
        "supermarket_usage_12m": F.when(k % 47 == 0, float("nan")).otherwise(number(k * 37 % 53)), "recreation_usage_12m": number(k * 41 % 17), "education_usage_12m": number(k * 43 % 7),
        "services_usage_index": F.when(k % 91 != 0, (k * 13 % 101) / 100.0), "months_since_last_credit": number(k * 5 % 48), "active_credit": number(k % 3),
        "tax_interest": flag(5, 0), "tourism_interest": flag(6, 1), "tech_interest": flag(7, 2), "health_interest": flag(8, 3),
        "company_size": _pick(k, 4, ["micro", "pequena", "mediana", None]), "city": _pick(k, 5, ["Bogota", "Medellin", "Cali", "Tunja", "Leticia"]),
        "life_event": _pick(k, 6, ["matrimonio", "nacimiento", None, "mudanza", "grado", "jubilacion"]), "job_sector": _pick(k, 3, ["servicios", "comercio", "industria"]),
    }
    return m.withColumns(more).select("member_id", *fixed.NUMERICAL_FEATURES, *fixed.CATEGORICAL_FEATURES)


def product_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member_id, product_id, raw, y): a score per member and product, and whether
    the member accepted it (null: never offered)."""
    scores = decision_members(spark, sf_dir).select("member_id", F.explode("p_accept").alias("product_id", "raw"))
    asked = interactions(spark, sf_dir).groupBy("member_id", "product_id").agg(F.max((F.col("outcome") == "accepted").cast("int")).alias("y"))
    return scores.join(asked, ["member_id", "product_id"], "left")
