"""Independent SQL statements of the same results, for DuckDB.

Each registered query has a SQL twin written from the operator's definition
(not generated from the Spark plan). Shared logical tables are CTEs that
restate the bindings of ``cauce.sources.derived``; ``sql(body, *ctes)``
prepends the CTEs a statement needs, in dependency order.
"""

from __future__ import annotations

CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, body: str, deps: list[str] | None = None) -> None:
    CTES[name] = (body, deps or [])


class SQLText:
    """SQL body + CTE names, rendered when first read (CTEs may be declared later)."""

    def __init__(self, body: str, names: tuple[str, ...]):
        self.body, self.names = body, names

    def render(self) -> str:
        return _render(self.body, *self.names)


def sql(body: str, *names: str) -> SQLText:
    return SQLText(body, names)


def _render(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + body


def pick(key: str, modulus: int, values: list) -> str:
    parts = []
    for i, v in enumerate(values):
        if v is None:
            lit = "NULL"
        elif isinstance(v, list):
            lit = "CAST([" + ", ".join(f"'{x}'" for x in v) + "] AS VARCHAR[])"
        else:
            lit = f"'{v}'"
        parts.append(f"WHEN {key} % {modulus} = {i} THEN {lit}")
    return "CASE " + " ".join(parts) + " END"


cte("persons", f"""
SELECT CAST(100000000 + c_custkey AS VARCHAR) AS cedula,
       c_name AS nombre,
       CASE WHEN c_custkey % 11 = 5 THEN '' WHEN c_custkey % 11 <> 0 THEN 'cliente' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS correo,
       'Calle ' || CAST(c_custkey % 100 AS VARCHAR) AS direccion,
       CASE WHEN c_custkey % 7 <> 0 THEN '573' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS telefono,
       c_custkey % 100 < 62 AS consent_whatsapp,
       c_custkey % 25 < 12 AS consent_email,
       CAST(18 + c_custkey * 31 % 52 AS INTEGER) AS edad,
       CAST(1400000 + (c_custkey * 7919 % 9000) * 1000 AS DOUBLE) AS ingresos,
       CAST(150 + c_custkey * 17 % 801 AS INTEGER) AS score_datacredito,
       CAST(c_custkey % 5 AS INTEGER) AS num_creditos_activos,
       CAST((1400000 + (c_custkey * 7919 % 9000) * 1000) * 2 AS DOUBLE) AS deuda_total_acumulada_cop,
       CAST((1400000 + (c_custkey * 7919 % 9000) * 1000) * 15 / 100 AS DOUBLE) AS cuota_mensual_total_cop,
       CAST(5 + c_custkey * 13 % 91 AS DOUBLE) AS capacidad_endeudamiento_disponible_pct,
       CASE WHEN 1400000 + (c_custkey * 7919 % 9000) * 1000 <= 2847000 THEN 'A'
            WHEN 1400000 + (c_custkey * 7919 % 9000) * 1000 <= 5694000 THEN 'B' ELSE 'C' END AS categoria_afiliacion,
       CASE WHEN c_custkey % 100 < 82 THEN '0_DIAS' WHEN c_custkey % 100 < 94 THEN '30_DIAS'
            WHEN c_custkey % 100 < 97 THEN '60_DIAS' ELSE '90_MAS_DIAS' END AS mora_maxima_historica,
       {pick('c_nationkey', 4, [['servicios'], ['comercio'], ['industria'], ['educacion']])} AS area_trabajo,
       CASE c_mktsegment WHEN 'BUILDING' THEN CAST(['vivienda'] AS VARCHAR[])
            WHEN 'MACHINERY' THEN CASE WHEN c_custkey % 2 = 0 THEN CAST(['Educacion', 'tecnologia'] AS VARCHAR[]) ELSE CAST(['educacion'] AS VARCHAR[]) END
            WHEN 'AUTOMOBILE' THEN CAST(['consolidacion'] AS VARCHAR[])
            WHEN 'FURNITURE' THEN CAST(['turismo', 'salud'] AS VARCHAR[]) END AS intereses,
       CASE WHEN c_acctbal >= 0 THEN CAST(['digital'] AS VARCHAR[]) ELSE CAST(['presencial'] AS VARCHAR[]) END AS preferencias,
       {pick('c_custkey', 5, [['inicio_semestre'], ['nacimiento_hijo', 'mudanza'], [], None, ['primer_empleo']])} AS momentos_clave,
       {pick('c_custkey', 3, [['pareja'], ['pareja', 'hijos'], ['soltero']])} AS composicion_familiar,
       {pick('c_custkey', 4, [['consumo'], ['vivienda', 'consumo'], [], None])} AS historial_creditos,
       CASE WHEN c_custkey % 20 < 3 THEN NULL ELSE
            {pick('c_custkey', 6, ['educativo', 'compra_cartera', 'hipotecario', 'libre_inversion', 'cupo_rotativo', 'turismo'])} END AS product_target,
       CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender
FROM customer""")

cte("id_uploads", """
SELECT 'batch-' || CAST(c_custkey // 1000 AS VARCHAR) AS batch_id,
       c_custkey AS pos,
       CASE WHEN c_custkey % 10 = 0 THEN concat_ws('.', substr(CAST(100000000 + c_custkey AS VARCHAR), 1, 3),
                                                     substr(CAST(100000000 + c_custkey AS VARCHAR), 4, 3),
                                                     substr(CAST(100000000 + c_custkey AS VARCHAR), 7, 3))
            WHEN c_custkey % 10 = 1 THEN ' ' || CAST(100000000 + c_custkey AS VARCHAR) || ' '
            WHEN c_custkey % 10 = 2 THEN 'abc' || CAST(c_custkey AS VARCHAR)
            WHEN c_custkey % 10 = 3 THEN CAST(100000000 + c_custkey + 7 AS VARCHAR)
            WHEN c_custkey % 10 = 4 THEN 'p' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')
            WHEN c_custkey % 10 = 5 THEN '12'
            ELSE CAST(100000000 + c_custkey AS VARCHAR) END AS raw_id
FROM customer""")

cte("triaged", """
SELECT batch_id, pos, raw_id,
       CASE WHEN ok THEN cleaned END AS person_id,
       CASE WHEN NOT ok THEN 'invalid'
            WHEN row_number() OVER (PARTITION BY batch_id, cleaned, ok ORDER BY pos) = 1 THEN 'valid'
            ELSE 'duplicate' END AS verdict
FROM (SELECT *, coalesce(regexp_full_match(cleaned, '[0-9]{5,11}') OR regexp_full_match(cleaned, 'P[0-9]{1,11}'), false) AS ok
      FROM (SELECT batch_id, pos, raw_id,
                   upper(regexp_replace(replace(raw_id, '.', ''), '^\\s+|\\s+$', '', 'g')) AS cleaned
            FROM id_uploads) s) t""", ["id_uploads"])

cte("intake", """
SELECT batch_id, raw_count, "count", invalid_count, duplicate_count,
       CASE WHEN raw_count > 10000 THEN 'too_many_raw' WHEN "count" > 2000 THEN 'too_large'
            WHEN "count" < 10 THEN 'too_small' ELSE 'accepted' END AS gate
FROM (SELECT batch_id, CAST(count(*) AS BIGINT) AS raw_count,
             CAST(count(*) FILTER (WHERE verdict = 'valid') AS BIGINT) AS "count",
             CAST(count(*) FILTER (WHERE verdict = 'invalid') AS BIGINT) AS invalid_count,
             CAST(count(*) FILTER (WHERE verdict = 'duplicate') AS BIGINT) AS duplicate_count
      FROM triaged GROUP BY batch_id) a""", ["triaged"])

cte("offers", """
SELECT person_id, person_name, outcome, detail,
       CASE WHEN outcome = 'offer' THEN product_id END AS product_id,
       CASE WHEN outcome = 'offer' THEN product_name END AS product_name,
       CASE WHEN outcome = 'offer' THEN '$' || replace(format('{:,}', CAST(round_even(amount / 1000.0, 0) * 1000 AS BIGINT)), ',', '.') END AS amount_cop,
       CASE WHEN outcome = 'offer' THEN replace(printf('%.1f', rate * 100), '.', ',') || '% E.A.' END AS annual_rate_pct,
       CASE WHEN outcome = 'offer' THEN 36 END AS term_months,
       CASE WHEN outcome = 'offer' THEN '$' || replace(format('{:,}', CAST(round_even(cuota / 1000.0, 0) * 1000 AS BIGINT)), ',', '.') END AS cuota_cop,
       CASE WHEN outcome = 'offer' THEN channel END AS channel,
       CASE WHEN outcome = 'offer' THEN contact_window END AS contact_window,
       CASE WHEN outcome = 'offer' THEN "trigger" END AS "trigger",
       CASE WHEN outcome = 'offer' THEN 'Te recomendamos ' || product_name || ' por tus intereses en ' || interest_txt
            || ' y tu capacidad de pago disponible del ' || printf('%.0f', round_even(cap, 0)) || '%.' END AS reason
FROM (
  SELECT *, amount * i / (1 - pow(1 + i, -36)) AS cuota
  FROM (
    SELECT *, max_cuota * (1 - pow(1 + i, -36)) / i AS amount
    FROM (
      SELECT *, pow(1 + rate, CAST(1 AS DOUBLE) / 12) - 1 AS i,
             CASE WHEN mora_maxima_historica = '90_MAS_DIAS' THEN 'no_offer'
                  WHEN ingresos IS NULL OR cap IS NULL THEN 'error'
                  WHEN max_cuota <= 0 THEN 'no_offer' ELSE 'offer' END AS outcome,
             CASE WHEN mora_maxima_historica = '90_MAS_DIAS' THEN 'mora_maxima_historica = 90_MAS_DIAS'
                  WHEN ingresos IS NULL OR cap IS NULL THEN 'missing income or capacity'
                  WHEN max_cuota <= 0 THEN 'max_cuota <= 0' END AS detail
      FROM (
        SELECT cedula AS person_id, coalesce(nombre, '') AS person_name, mora_maxima_historica, ingresos,
               capacidad_endeudamiento_disponible_pct AS cap,
               ingresos * CAST(0.30 AS DOUBLE) * (capacidad_endeudamiento_disponible_pct / CAST(100 AS DOUBLE)) AS max_cuota,
               CASE categoria_afiliacion WHEN 'A' THEN CAST(0.145 AS DOUBLE) WHEN 'B' THEN CAST(0.165 AS DOUBLE)
                    WHEN 'C' THEN CAST(0.185 AS DOUBLE) ELSE CAST(0.185 AS DOUBLE) END AS rate,
               CASE WHEN list_contains(list_transform(coalesce(intereses, CAST([] AS VARCHAR[])), lambda x: lower(x)), 'educacion') THEN 'educativo'
                    WHEN list_contains(list_transform(coalesce(intereses, CAST([] AS VARCHAR[])), lambda x: lower(x)), 'consolidacion') THEN 'compra_cartera'
                    WHEN list_contains(list_transform(coalesce(intereses, CAST([] AS VARCHAR[])), lambda x: lower(x)), 'vivienda') THEN 'hipotecario'
                    ELSE 'libre_inversion' END AS product_id,
               CASE WHEN list_contains(list_transform(coalesce(intereses, CAST([] AS VARCHAR[])), lambda x: lower(x)), 'educacion') THEN 'Crédito Educativo'
                    WHEN list_contains(list_transform(coalesce(intereses, CAST([] AS VARCHAR[])), lambda x: lower(x)), 'consolidacion') THEN 'Compra de Cartera'
                    WHEN list_contains(list_transform(coalesce(intereses, CAST([] AS VARCHAR[])), lambda x: lower(x)), 'vivienda') THEN 'Crédito Hipotecario'
                    ELSE 'Crédito de Libre Inversión' END AS product_name,
               CASE WHEN coalesce(consent_whatsapp, false) AND coalesce(length(telefono) > 0, false) THEN 'whatsapp'
                    WHEN coalesce(consent_email, false) AND coalesce(length(correo) > 0, false) THEN 'email'
                    ELSE 'app' END AS channel,
               CASE WHEN coalesce(edad, 40) < 40 THEN 'night' ELSE 'morning' END AS contact_window,
               coalesce(momentos_clave[1], 'inmediato') AS "trigger",
               CASE WHEN array_to_string(coalesce(intereses, CAST([] AS VARCHAR[])), ', ') = '' THEN 'tu perfil financiero'
                    ELSE array_to_string(coalesce(intereses, CAST([] AS VARCHAR[])), ', ') END AS interest_txt
        FROM persons) a) b) c) d""", ["persons"])

cte("results", """
SELECT t.batch_id, t.pos, t.person_id,
       CASE WHEN o.person_id IS NULL THEN 'person_not_found'
            WHEN o.outcome = 'offer' THEN 'processed' ELSE o.outcome END AS result_status,
       o.outcome, o.product_id, o.product_name, o.amount_cop, o.annual_rate_pct, o.term_months, o.cuota_cop,
       o.channel, o.contact_window, o."trigger", o.reason, o.person_name
FROM (SELECT tr.* FROM triaged tr JOIN intake i ON tr.batch_id = i.batch_id
      WHERE tr.verdict = 'valid' AND i.gate = 'accepted') t
LEFT JOIN offers o ON t.person_id = o.person_id""", ["triaged", "intake", "offers"])
