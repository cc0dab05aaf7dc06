"""Data-quality, population, split and encoder queries over the member table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce import fixed
from cauce.operators import quality
from cauce.operators.encode import FeatureEncoder
from cauce.plans.oracle import cte, sql
from cauce.plans.registry import register
from cauce.sources import derived

DIGITS = 10


def _rules_sql() -> str:
    parts = [f"SELECT '{name}' AS rule, CAST(count(*) AS BIGINT) AS n_checked, "
             f"CAST(count(*) FILTER (WHERE NOT coalesce(({cond}), false)) AS BIGINT) AS n_violations FROM persons"
             for name, cond in quality.PERSON_RULES]
    parts.append("SELECT 'cedula_unique', CAST(count(*) AS BIGINT), CAST(count(*) - count(DISTINCT cedula) AS BIGINT) FROM persons")
    return "\nUNION ALL ".join(parts)


@register("quality_violations", "V-08, A-30, T-03", sql(_rules_sql(), "persons"))
def quality_violations(spark, sf_dir):
    return quality.rule_violations(derived.persons(spark, sf_dir))


cte("contract", f"""
SELECT m.member_id, age, income, CASE WHEN k % 53 <> 0 THEN CAST(k * 19 % 40 AS DOUBLE) END AS tenure_months, job_tenure_months, dependents, internal_score, debt_ratio,
       CAST(k * 23 % 13 AS DOUBLE) AS subsidy_usage_12m, CASE WHEN k % 47 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(k * 37 % 53 AS DOUBLE) END AS supermarket_usage_12m,
       CAST(k * 41 % 17 AS DOUBLE) AS recreation_usage_12m, CAST(k * 43 % 7 AS DOUBLE) AS education_usage_12m,
       CASE WHEN k % 91 <> 0 THEN CAST(k * 13 % 101 AS DOUBLE) / 100 END AS services_usage_index, CAST(k * 5 % 48 AS DOUBLE) AS months_since_last_credit,
       CAST(current_delinquency AS DOUBLE) AS current_delinquency, CAST(k % 3 AS DOUBLE) AS active_credit, has_mortgage, digital_affinity, months_since_event,
       CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS education_interest, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS housing_interest, CAST(c_mktsegment = 'AUTOMOBILE' AS DOUBLE) AS consolidation_interest,
       CAST(k % 5 = 0 AS DOUBLE) AS tax_interest, CAST(k % 6 = 1 AS DOUBLE) AS tourism_interest, CAST(k % 7 = 2 AS DOUBLE) AS tech_interest, CAST(k % 8 = 3 AS DOUBLE) AS health_interest,
       category, contract_type, CASE k % 4 WHEN 0 THEN 'micro' WHEN 1 THEN 'pequena' WHEN 2 THEN 'mediana' END AS company_size,
       ['Bogota', 'Medellin', 'Cali', 'Tunja', 'Leticia'][CAST(k % 5 + 1 AS INTEGER)] AS city,
       CASE k % 6 WHEN 0 THEN 'matrimonio' WHEN 1 THEN 'nacimiento' WHEN 3 THEN 'mudanza' WHEN 4 THEN 'grado' WHEN 5 THEN 'jubilacion' END AS life_event,
       ['servicios', 'comercio', 'industria'][CAST(k % 3 + 1 AS INTEGER)] AS job_sector
FROM (SELECT *, CAST(member_id AS BIGINT) - 100000000 AS k FROM members) m JOIN customer ON c_custkey = m.k""", ["members"])


@register("model_input", "V-10, V-11, T-01", sql("SELECT * FROM contract", "contract"))
def model_input(spark, sf_dir):
    """The contract's 31 features of every member, whatever else the frame holds."""
    return quality.model_input(derived.contract_features(spark, sf_dir).withColumn("gender", F.lit("Female")))


@register("missing_features", "V-12", sql("\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS BIGINT) AS n_bad FROM contract"
    for c in fixed.NUMERICAL_FEATURES), "contract"))
def missing_features(spark, sf_dir):
    return quality.missing_numeric(derived.contract_features(spark, sf_dir), fixed.NUMERICAL_FEATURES)


OOV_VOCAB = {"category": ["A", "B", "C", "D"], "contract_type": ["indefinido", "fijo"], "company_size": ["micro", "pequena", "mediana"],
             "city": ["Bogota", "Medellin", "Cali", "Tunja"], "life_event": ["matrimonio", "nacimiento", "mudanza", "grado", "jubilacion"], "job_sector": ["servicios", "comercio", "industria"]}
_KNOWN = {c: f"coalesce({c} IN ({', '.join(repr(v) for v in vs)}), false)" for c, vs in OOV_VOCAB.items()}


@register("oov_rates", "V-13", sql("\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", n, n_oov, round(n_oov / CAST(n AS DOUBLE), {DIGITS}) AS oov_rate,
       CASE WHEN n_oov / CAST(n AS DOUBLE) > 0.2 THEN 'reject' WHEN n_oov > 0 THEN 'warn' ELSE 'ok' END AS verdict
FROM (SELECT CAST(count(*) AS BIGINT) AS n,
             CAST(count(*) FILTER (WHERE NOT {known}) AS BIGINT) AS n_oov FROM contract) x"""
    for c, known in _KNOWN.items()), "contract"))
def oov_rates(spark, sf_dir):
    out = quality.oov_rates(derived.contract_features(spark, sf_dir), OOV_VOCAB)
    return out.withColumn("oov_rate", F.round("oov_rate", DIGITS))


@register("rejected_input", "V-12, V-13", sql(f"""
SELECT * FROM (
  SELECT member_id, list_filter([{', '.join(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN '{c}' END" for c in fixed.NUMERICAL_FEATURES)}], lambda x: x IS NOT NULL) AS missing,
         list_filter([{', '.join(f"CASE WHEN NOT {known} THEN '{c}' END" for c, known in _KNOWN.items())}], lambda x: x IS NOT NULL) AS unknown
  FROM contract) x WHERE len(missing) > 0 OR len(unknown) > 0""", "contract"))
def rejected_input(spark, sf_dir):
    """Members whose input is rejected (missing numbers) or warned about, with the features."""
    return quality.rejected_input(derived.contract_features(spark, sf_dir), OOV_VOCAB)


@register("label_vocabularies", "A-05, E-04, U-05", sql("\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", list_sort(list(DISTINCT l)) AS vocabulary
FROM (SELECT unnest({c}) AS l FROM persons) x WHERE l IS NOT NULL""" for c in fixed.MULTILABEL_COLS), "persons"))
def label_vocabularies(spark, sf_dir):
    return quality.label_vocabularies(derived.persons(spark, sf_dir), fixed.MULTILABEL_COLS)


@register("population_profile", "A-06", sql("""
SELECT dimension, value, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'categoria_afiliacion' AS dimension, categoria_afiliacion AS value FROM persons
  UNION ALL SELECT 'product_target', coalesce(product_target, '(sin producto)') FROM persons
  UNION ALL SELECT 'mora_maxima_historica', mora_maxima_historica FROM persons) x
GROUP BY dimension, value""", "persons"))
def population_profile(spark, sf_dir):
    return quality.population_profile(derived.persons(spark, sf_dir))


@register("top_targets", "W-10", sql("""
SELECT coalesce(product_target, '(sin producto)') AS target, CAST(count(*) AS BIGINT) AS n FROM persons
GROUP BY 1 ORDER BY n DESC, target LIMIT 5""", "persons"))
def top_targets(spark, sf_dir):
    return quality.top_targets(derived.persons(spark, sf_dir))


@register("pii_free_profile", "V-14, V-15, Q-03", sql("""
SELECT cedula, edad, ingresos, score_datacredito, num_creditos_activos, deuda_total_acumulada_cop, cuota_mensual_total_cop,
       capacidad_endeudamiento_disponible_pct, categoria_afiliacion, mora_maxima_historica, area_trabajo, intereses,
       preferencias, momentos_clave, composicion_familiar, historial_creditos, product_target FROM persons""", "persons"))
def pii_free_profile(spark, sf_dir):
    return quality.pii_free_profile(derived.persons(spark, sf_dir))


@register("masked_contacts", "V-16", sql("""
SELECT cedula, CASE WHEN length(telefono) > 0 THEN '******' || right(telefono, 4) END AS telefono_masked FROM persons""", "persons"))
def masked_contacts(spark, sf_dir):
    return quality.masked_contacts(derived.persons(spark, sf_dir))


FP_COLS = ["cedula", "nombre", "edad", "categoria_afiliacion", "mora_maxima_historica"]


@register("dataset_fingerprint", "A-29", sql("""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CAST(('0x' || substr(sha256(concat_ws('|', cedula, nombre, CAST(edad AS VARCHAR), categoria_afiliacion,
                                                         mora_maxima_historica)), 1, 13)) AS BIGINT)) AS VARCHAR) AS fingerprint
FROM persons""", "persons"))
def dataset_fingerprint(spark, sf_dir):
    return quality.row_fingerprint(derived.persons(spark, sf_dir), FP_COLS)


cte("mixed_ids", """
SELECT CASE WHEN c % 5 = 0 THEN 'P' || CAST(c AS VARCHAR) WHEN c % 5 = 1 THEN CAST(c * 97 + 10000000000 AS VARCHAR) ELSE cedula END AS cedula,
       categoria_afiliacion
FROM (SELECT cedula, categoria_afiliacion, CAST(cedula AS BIGINT) AS c FROM persons) x""", ["persons"])
cte("split_s", """
SELECT cedula, categoria_afiliacion, r, n,
       CASE WHEN r * 10 < 6 * n THEN 'train' WHEN r * 10 < 8 * n THEN 'valid' ELSE 'test' END AS split
FROM (SELECT cedula, categoria_afiliacion,
             row_number() OVER (PARTITION BY categoria_afiliacion
                                ORDER BY substr(sha256('42:' || cedula), 1, 13), cedula) - 1 AS r,
             count(*) OVER (PARTITION BY categoria_afiliacion) AS n
      FROM mixed_ids) x""", ["mixed_ids"])


def _split_sql(body: str):
    return sql(body, "split_s")


def mixed_ids(spark, sf_dir):
    """Members with ids of every form: 9 digits, 11 digits, P and digits."""
    p = derived.persons(spark, sf_dir).select("cedula", "categoria_afiliacion")
    c = F.col("cedula").cast("bigint")
    return p.withColumn("cedula", F.when(c % 5 == 0, F.concat(F.lit("P"), F.col("cedula"))).when(c % 5 == 1, (c * 97 + 10000000000).cast("string")).otherwise(F.col("cedula")))


@register("split_assignment", "W-13", _split_sql("SELECT cedula, categoria_afiliacion, split FROM split_s"))
def split_assignment(spark, sf_dir):
    p = mixed_ids(spark, sf_dir)
    return quality.stratified_split(p, "cedula", "categoria_afiliacion").select("cedula", "categoria_afiliacion", "split")


@register("split_sizes", "A-31, W-13", _split_sql(
    "SELECT categoria_afiliacion, split, CAST(count(*) AS BIGINT) AS n FROM split_s GROUP BY 1, 2"))
def split_sizes(spark, sf_dir):
    p = mixed_ids(spark, sf_dir)
    s = quality.stratified_split(p, "cedula", "categoria_afiliacion")
    return s.groupBy("categoria_afiliacion", "split").agg(F.count(F.lit(1)).alias("n"))


@register("sample_rows", "W-12", sql("""
SELECT cedula, categoria_afiliacion FROM mixed_ids
ORDER BY substr(sha256('42:' || cedula), 1, 13), cedula LIMIT 1000""", "mixed_ids"))
def sample_rows(spark, sf_dir):
    return quality.sample_rows(mixed_ids(spark, sf_dir), "cedula")


def _encoded_sql() -> str:
    vocab = {
        "categoria_afiliacion": ["A", "B", "C"],
        "area_trabajo": ["comercio", "educacion", "industria", "servicios"],
        "intereses": ["Educacion", "consolidacion", "educacion", "salud", "tecnologia", "turismo", "vivienda"],
        "preferencias": ["digital", "presencial"],
        "momentos_clave": ["inicio_semestre", "mudanza", "nacimiento_hijo", "primer_empleo"],
        "composicion_familiar": ["hijos", "pareja", "soltero"],
        "historial_creditos": ["consumo", "vivienda"],
    }
    enc = FeatureEncoder(vocab)
    cols = ["cedula", "product_target"] + [f"CAST({c} AS DOUBLE) AS {c}" for c in fixed.NUMERIC_COLS]
    for v, n in zip(vocab["categoria_afiliacion"], enc._value_names("categoria_afiliacion")):
        cols.append(f"coalesce(CAST(categoria_afiliacion = '{v}' AS DOUBLE), 0.0) AS \"{n}\"")
    cols.append("CAST(coalesce(list_position(['0_DIAS', '30_DIAS', '60_DIAS', '90_MAS_DIAS'], mora_maxima_historica), 0) - 1 AS DOUBLE)"
                " AS mora_maxima_historica")
    for c in fixed.MULTILABEL_COLS:
        for v, n in zip(vocab[c], enc._value_names(c)):
            cols.append(f"CAST(list_contains(coalesce({c}, CAST([] AS VARCHAR[])), '{v}') AS DOUBLE) AS \"{n}\"")
    return "SELECT " + ",\n       ".join(cols) + " FROM persons"


@register("encoded_features", "E-01, E-02, E-03, E-04, E-05, E-06, E-07, T-05", sql(_encoded_sql(), "persons"))
def encoded_features(spark, sf_dir):
    persons = derived.persons(spark, sf_dir)
    enc = FeatureEncoder().fit(persons)
    return enc.transform(persons, keep=["cedula"])
