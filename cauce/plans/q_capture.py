"""Stored rows, prompts, data capture and cascades: queries with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.operators import campaign, capture, prompts, stored_rows
from cauce.operators.intake import triage_ids
from cauce.plans.oracle import cte, sql
from cauce.plans.registry import register
from cauce.sources import derived, publish
from cauce.sources.tables import read_table


@register("stored_persons", "V-18, V-09", sql("""
SELECT cedula, CASE WHEN k % 23 <> 0 THEN ingresos END AS ingresos, capacidad_endeudamiento_disponible_pct,
       CASE WHEN k % 37 = 0 THEN 0 ELSE num_creditos_activos END AS num_creditos_activos,
       CASE WHEN k % 41 <> 0 THEN consent_whatsapp END AS consent_whatsapp,
       CASE WHEN k % 31 = 0 THEN '0_DIAS' ELSE mora_maxima_historica END AS mora_maxima_historica,
       CASE WHEN k % 29 = 0 THEN CAST([] AS VARCHAR[]) ELSE coalesce(intereses, CAST([] AS VARCHAR[])) END AS intereses,
       coalesce(momentos_clave, CAST([] AS VARCHAR[])) AS momentos_clave,
       concat_ws(';', CASE WHEN k % 41 = 0 THEN 'consent_whatsapp=maybe' END, CASE WHEN k % 23 = 0 THEN 'ingresos=1.234,5' END,
                 CASE WHEN k % 29 = 0 THEN 'intereses=["vivienda"' END) AS errors
FROM (SELECT *, CAST(cedula AS BIGINT) AS k FROM persons) p""", "persons"))
def stored_persons(spark, sf_dir):
    """Every person to its stored form and back; some stored values are missing or damaged on the way."""
    k = F.col("cedula").cast("long")
    rows = stored_rows.to_stored(derived.persons(spark, sf_dir)).withColumns({
        "ingresos": F.when(k % 23 == 0, "1.234,5").otherwise(F.col("ingresos").cast("string")),
        "consent_whatsapp": F.when(k % 41 == 0, "maybe").otherwise(F.col("consent_whatsapp").cast("string")),
        "intereses": F.when(k % 29 == 0, '["vivienda"').otherwise(F.col("intereses")),
        "num_creditos_activos": F.when(k % 37 != 0, F.col("num_creditos_activos")),
        "mora_maxima_historica": F.when(k % 31 != 0, F.col("mora_maxima_historica"))})
    out = stored_rows.from_stored(rows)
    return out.select("cedula", "ingresos", "capacidad_endeudamiento_disponible_pct", "num_creditos_activos", "consent_whatsapp", "mora_maxima_historica", "intereses",
                      "momentos_clave", F.array_join(F.transform("errors", lambda e: F.concat_ws("=", e["field"], e["value"])), ";").alias("errors"))


@register("prompt_table", "F-22, F-23, F-19, F-21", sql(r"""
SELECT batch_id, person_id, channel,
       CASE WHEN error IS NULL THEN '<persona>' || replace(replace(trim(name), '{', '('), '}', ')') || '</persona>' || chr(10)
         || '<producto>' || product_name || '</producto>' || chr(10)
         || '<beneficios>' || reason || ' Monto: ' || amount_cop || ' · Tasa: ' || annual_rate_pct || ' · Plazo: ' || CAST(term_months AS VARCHAR) || ' meses · Cuota: ' || cuota_cop
         || '</beneficios>' || chr(10) || chr(10) || 'Crea un mensaje de ' || CASE channel WHEN 'whatsapp' THEN 'WhatsApp' ELSE 'correo electrónico' END
         || ' para la persona recomendando el producto. Menciona los beneficios listados arriba, copiando los valores numéricos (tasas, montos, plazos y cuotas) '
         || 'exactamente como aparecen, sin modificarlos, redondearlos ni inventar otros.' || chr(10) || chr(10) || 'Reglas:' || chr(10)
         || CASE channel WHEN 'whatsapp' THEN '- 1 a 3 oraciones cortas.' || chr(10) || '- Puedes usar emojis para dar calidez.' || chr(10)
                || '- Tono conversacional, como un mensaje entre amigos.'
              ELSE '- 2 a 4 oraciones.' || chr(10) || '- Incluye un saludo inicial (ej. ''Hola María,'') y una despedida cordial.' || chr(10)
                || '- Más detallado pero manteniendo un tono amigable y cercano.' || chr(10) || '- Sin asunto (subject), solo el cuerpo del correo.' END
         || chr(10) || '- Solo el texto del mensaje, nada más.' END AS prompt, error
FROM (SELECT *, CASE WHEN trim(name) = '' THEN 'blank_name' WHEN channel NOT IN ('whatsapp', 'email') THEN 'unknown_channel' END AS error
      FROM (SELECT *, CASE WHEN CAST(substr(person_id, 2) AS BIGINT) % 17 = 0 THEN '  ' WHEN CAST(substr(person_id, 2) AS BIGINT) % 13 = 0 THEN ' {' || person_name || '}' ELSE person_name END AS name
            FROM results WHERE result_status = 'processed') a) b""", "results"))
def prompt_table(spark, sf_dir):
    """A prompt, or the reason why there is none, for every processed member; some names are blank or hold braces."""
    done = campaign.run_campaign(derived.id_uploads(spark, sf_dir), derived.persons(spark, sf_dir))["results"].filter(F.col("result_status") == "processed")
    k = F.substring("person_id", 2, 20).cast("long")
    name = F.when(k % 17 == 0, F.lit("  ")).when(k % 13 == 0, F.concat(F.lit(" {"), F.col("person_name"), F.lit("}\n"))).otherwise(F.col("person_name"))
    return prompts.prompt_table(done.withColumn("person_name", name), ["batch_id", "person_id"])


LINES = ["carros", "motos", "bicicletas_patinetas", "mascotas"]
ASKED = ["departamento", "placa", "tipo_activo", "tipo_bicicleta", "marca", "fecha_nacimiento", "raza"]

cte("capture_answers", """
SELECT CAST(100000000 + user_id AS VARCHAR) AS member_id, ['carros', 'motos', 'bicicletas_patinetas', 'mascotas'][event_id % 4 + 1] AS line,
       ['departamento', 'placa', 'tipo_activo', 'tipo_bicicleta', 'marca', 'fecha_nacimiento', 'raza'][event_id % 7 + 1] AS field,
       CASE WHEN event_id % 5 = 0 THEN ' ' WHEN event_id % 3 = 0 THEN 'bicicleta' ELSE 'patineta' END AS value
FROM events""")
cte("line_fields", """
SELECT line, unnest(fields) AS field, unnest(range(1, len(fields) + 1)) AS place FROM (VALUES
 ('carros', ['nombre', 'telefono', 'correo', 'departamento', 'municipio', 'placa', 'marca', 'anio_modelo', 'linea', 'cilindraje', 'cero_km', 'endoso']),
 ('motos', ['nombre', 'telefono', 'correo', 'departamento', 'municipio', 'placa', 'marca', 'anio_modelo', 'linea', 'cilindraje', 'cero_km', 'endoso']),
 ('bicicletas_patinetas', ['nombre', 'telefono', 'correo', 'departamento', 'municipio', 'fecha_nacimiento', 'fecha_expedicion', 'tipo_activo', 'tipo_bicicleta', 'marca',
                           'linea', 'anio_modelo', 'fecha_compra', 'valor_comercial', 'valor_accesorios']),
 ('mascotas', ['nombre', 'fecha_nacimiento', 'fecha_expedicion', 'ocupacion', 'salario', 'profesion', 'telefono', 'correo', 'nombre_mascota', 'tipo_mascota', 'edad_mascota',
               'color', 'raza', 'peso', 'vacunas', 'enfermedades'])) t(line, fields)""")


@register("missing_fields", "P-08", sql("""
SELECT p.cedula AS member_id, l.line, coalesce(list(l.field ORDER BY l.place) FILTER (WHERE ask), CAST([] AS VARCHAR[])) AS missing, count(*) FILTER (WHERE ask) AS n_missing
FROM (SELECT p.cedula, f.line, f.field, f.place,
        NOT (f.field = 'nombre' AND coalesce(trim(p.nombre), '') <> '' OR f.field = 'telefono' AND coalesce(trim(p.telefono), '') <> ''
             OR f.field = 'correo' AND coalesce(trim(p.correo), '') <> '' OR f.field = 'salario' AND p.ingresos IS NOT NULL)
        AND a.field IS NULL AND m.field IS NULL AND (f.field <> 'tipo_bicicleta' OR b.member_id IS NOT NULL) AS ask
      FROM persons p CROSS JOIN line_fields f
      LEFT JOIN (SELECT DISTINCT member_id, line, field FROM capture_answers WHERE value <> ' ') a
        ON a.member_id = p.cedula AND a.line = f.line AND a.field = f.field
      LEFT JOIN (SELECT DISTINCT member_id, field FROM capture_answers WHERE value <> ' ' AND field IN ('departamento', 'fecha_nacimiento')) m
        ON m.member_id = p.cedula AND m.field = f.field
      LEFT JOIN (SELECT DISTINCT member_id FROM capture_answers WHERE line = 'bicicletas_patinetas' AND field = 'tipo_activo' AND value = 'bicicleta') b
        ON b.member_id = p.cedula) l JOIN persons p ON p.cedula = l.cedula
GROUP BY p.cedula, l.line""", "persons", "line_fields", "capture_answers"))
def missing_fields(spark, sf_dir):
    """What each member still has to be asked for each line; answers come from the events."""
    e = F.col("event_id")
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (e % n + 1).cast("int"))
    value = F.when(e % 5 == 0, " ").when(e % 3 == 0, "bicicleta").otherwise("patineta")
    answers = read_table(spark, sf_dir, "events").select((F.lit(derived.CEDULA_BASE) + F.col("user_id")).cast("string").alias("member_id"),
                                                         at(LINES, 4).alias("line"), at(ASKED, 7).alias("field"), value.alias("value"))
    members = derived.persons(spark, sf_dir).withColumnRenamed("cedula", "member_id")
    return capture.missing_fields(members, answers, {"nombre": "nombre", "telefono": "telefono", "correo": "correo", "salario": "ingresos"})


@register("pet_vaccines", "F-33", sql("""
SELECT event_id, CASE WHEN event_id % 10 = 9 THEN CAST([] AS VARCHAR[])
       ELSE list_filter([CASE WHEN event_id % 2 = 0 THEN 'Rabia' END, CASE WHEN event_id % 3 = 0 THEN 'Moquillo' END, CASE WHEN event_id % 5 = 0 THEN 'Parvovirus' END], lambda x: x IS NOT NULL) END AS applied
FROM events"""))
def pet_vaccines(spark, sf_dir):
    """Applied vaccines of one form per event; some forms are cut off."""
    e = F.col("event_id")
    form = F.to_json(F.array(*[F.struct(F.lit(n).alias("vacuna"), (e % m == 0).alias("aplicada")) for n, m in (("Rabia", 2), ("Moquillo", 3), ("Parvovirus", 5))]))
    return read_table(spark, sf_dir, "events").select("event_id", capture.applied_items(F.when(e % 10 == 9, F.substring(form, 1, 40)).otherwise(form), "vacuna", "aplicada").alias("applied"))


@register("cascade_delete", "J-11", sql("""
SELECT batch_id, count(*) AS n_rows FROM triaged
WHERE CAST(substr(batch_id, 7) AS BIGINT) % 3 <> 1 GROUP BY batch_id""", "triaged"))
def cascade_delete(spark, sf_dir):
    """Rows left per batch after every third batch is deleted."""
    rows = triage_ids(derived.id_uploads(spark, sf_dir))
    gone = rows.filter(F.substring("batch_id", 7, 20).cast("long") % 3 == 1)
    return publish.without_batches({"batch_persons": rows}, gone)["batch_persons"].groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"))
