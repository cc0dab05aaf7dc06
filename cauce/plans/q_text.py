"""Text and conversation queries over ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce import fixed
from cauce.operators import chat
from cauce.plans.oracle import cte, sql
from cauce.plans.registry import register
from cauce.sources.tables import read_table

STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _strip(x: str) -> str:
    return STRIP.format(x)


def _prefix_case(t: str) -> str:
    parts = []
    for p in fixed.COMMON_PREFIXES:
        parts.append(f"WHEN starts_with(lower({t}), '{p.lower()}') THEN {_strip(f'substr({t}, {len(p) + 1})')}")
    return "CASE " + " ".join(parts) + f" ELSE {t} END"


cte("clean1", f"""
SELECT conv_id, turn,
       regexp_replace(replace(regexp_replace({_strip('text')}, '```[^\\n]*\\n?', '', 'g'), '```', ''), '\\*\\*(.+?)\\*\\*', '\\1', 'g') AS t
FROM conversations WHERE role = 'assistant'""")
cte("clean2", f"SELECT conv_id, turn, {_prefix_case('t')} AS t FROM clean1", ["clean1"])
cte("clean3", f"""
SELECT conv_id, turn,
       {_strip('''CASE WHEN length(t) >= 1 AND ((starts_with(t, '"') AND ends_with(t, '"')) OR (starts_with(t, chr(39)) AND ends_with(t, chr(39))))
            THEN CASE WHEN length(t) >= 2 THEN substr(t, 2, length(t) - 2) ELSE '' END ELSE t END''')} AS t
FROM clean2""", ["clean2"])


@register("clean_generated_text", "F-24", sql("""
SELECT conv_id, turn, CASE WHEN length(t) > 0 THEN t END AS cleaned_text, length(t) > 0 AS clean_ok FROM clean3""", "clean3"))
def clean_generated_text(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return chat.clean_responses(conv, ["conv_id", "turn"])


# FIXED VALUES: the trigger phrases, written out for the oracle on their own
ORACLE_PHRASES = """
(0, 'thank_you', 'gracias'),
(1, 'thank_you', 'gracias a ti'),
(2, 'thank_you', 'gracias a usted'),
(3, 'thank_you', 'muchas gracias'),
(4, 'thank_you', 'grcs'),
(5, 'goodbye', 'Adiós'),
(6, 'goodbye', 'Hasta pronto'),
(7, 'goodbye', 'Hasta otra'),
(8, 'goodbye', '¡Adiós!'),
(9, 'goodbye', 'No, gracias. Adiós.'),
(10, 'goodbye', 'No, gracias a ti, adiós.'),
(11, 'goodbye', 'No, gracias a usted, adiós.'),
(12, 'goodbye', '¡Hasta luego!'),
(13, 'escalate', 'Hablar con un agente'),
(14, 'escalate', 'Hablar con una persona'),
(15, 'escalate', 'Hablar con alguien'),
(16, 'escalate', 'Devolver llamada'),
(17, 'escalate', 'Llamar al servicio al cliente'),
(18, 'escalate', 'Llámeme, por favor'),
(19, 'escalate', 'Llámame, por favor'),
(20, 'escalate', 'Llamar a soporte'),
(21, 'escalate', 'Llamar a soporte técnico'),
(22, 'escalate', 'Llamar al soporte técnico'),
(23, 'escalate', '¿Puede llamarme un agente?'),
(24, 'escalate', '¿Puedo llamar?'),
(25, 'escalate', '¿Puedo contactar con otra persona?'),
(26, 'escalate', '¿Puedo ponerme en contacto con otra persona?'),
(27, 'escalate', '¿Puedo obtener soporte de un agente real?'),
(28, 'escalate', '¿Me pueden transferir la llamada a una persona?'),
(29, 'escalate', '¿Me pueden llamar?'),
(30, 'escalate', '¿Me puede llamar un representante?'),
(31, 'escalate', '¿Puedo programar una llamada?'),
(32, 'escalate', '¿Puedo hablar con un representante?'),
(33, 'escalate', '¿Puedo hablar con un humano?'),
(34, 'escalate', '¿Puedo hablar con un asistente humano?'),
(35, 'escalate', '¿Puede llamarme alguien?'),
(36, 'escalate', 'Charlar con un humano'),
(37, 'escalate', 'Charlar con un representante'),
(38, 'escalate', 'Charlar con un agente'),
(39, 'escalate', 'Charlar con alguien'),
(40, 'escalate', 'Conéctame con un agente por chat'),
(41, 'escalate', 'Conécteme con un agente por chat'),
(42, 'escalate', 'Conectarme con un agente por chat'),
(43, 'escalate', 'Conéctame con una persona'),
(44, 'escalate', 'Conécteme con una persona'),
(45, 'escalate', 'Conectarme con una persona'),
(46, 'escalate', '¿Me podría contactar alguien por teléfono?'),
(47, 'escalate', 'Agente de atención al cliente'),
(48, 'escalate', 'Representante del cliente'),
(49, 'escalate', 'Servicio de atención al cliente'),
(50, 'escalate', 'Necesito hablar con un responsable'),
(51, 'escalate', 'Necesito que un responsable se ponga en contacto conmigo'),
(52, 'escalate', 'Necesito atención al cliente'),
(53, 'escalate', 'Necesito ayuda de una persona'),
(54, 'escalate', 'Necesito hablar con un agente por chat'),
(55, 'escalate', 'Necesito hablar con un especialista'),
(56, 'escalate', 'Quiero hablar con el servicio de atención al cliente'),
(57, 'escalate', 'Quiero continuar con el soporte por chat'),
(58, 'escalate', 'Quiero hablar con un consultor'),
(59, 'escalate', 'Quiero hablar con un técnico por chat'),
(60, 'escalate', 'Me gustaría hablar con un asociado'),
(61, 'escalate', 'Me gustaría hablar con un técnico'),
(62, 'escalate', 'Me gustaría hablar con un miembro del soporte técnico'),
(63, 'escalate', 'Me gustaría hablar con alguien de soporte técnico'),
(64, 'start_over', 'empecemos de nuevo'),
(65, 'start_over', 'vamos a empezar de nuevo'),
(66, 'start_over', 'comencemos de nuevo'),
(67, 'start_over', 'volver a empezar'),
(68, 'start_over', 'volver a comenzar'),
(69, 'start_over', 'empezar de nuevo'),
(70, 'start_over', 'comenzar de nuevo'),
(71, 'start_over', 'reiniciar'),
(72, 'start_over', 'reanudar'),
(73, 'soat', 'soat information'),
(74, 'soat', 'what is soat'),
(75, 'soat', 'soat requirements'),
(76, 'soat', 'how to get soat'),
(77, 'soat', 'soat renewal'),
(78, 'soat', 'soat cost'),
(79, 'soat', 'buy soat online'),
(80, 'soat', 'is my soat valid'),
(81, 'soat', 'soat insurance details'),
(82, 'soat', 'where can I purchase soat'),
(83, 'bicycles', 'información seguro bicicletas Colsubsidio'),
(84, 'bicycles', 'cotización seguro patinetas Colsubsidio'),
(85, 'bicycles', 'quiero asegurar mi bicicleta con Colsubsidio'),
(86, 'bicycles', 'precio seguro para patineta en Colsubsidio'),
(87, 'bicycles', 'cómo funciona el seguro de bicicletas Colsubsidio'),
(88, 'bicycles', 'beneficios del seguro de patinetas Colsubsidio'),
(89, 'bicycles', 'solicitar cotización de seguro para bicicleta y patineta'),
(90, 'bicycles', 'seguro para bicicletas y patinetas en Colsubsidio'),
(91, 'bicycles', 'protección para mi bicicleta con Colsubsidio'),
(92, 'cars', 'información de seguro para carros'),
(93, 'cars', 'cotización de seguro de auto'),
(94, 'cars', 'quiero asegurar mi carro'),
(95, 'cars', 'precio del seguro para autos'),
(96, 'cars', 'cómo obtener un seguro para mi coche'),
(97, 'cars', 'cuánto cuesta el seguro de carro'),
(98, 'cars', 'necesito información sobre seguros automotrices'),
(99, 'cars', 'solicitar cotización de seguro vehicular'),
(100, 'cars', 'asegurar mi vehículo'),
(101, 'cars_fund', 'información de seguro para carros Colsubsidio'),
(102, 'cars_fund', 'cotización de seguro de auto Colsubsidio'),
(103, 'cars_fund', 'quiero asegurar mi carro con Colsubsidio'),
(104, 'cars_fund', 'precio del seguro para autos Colsubsidio'),
(105, 'cars_fund', 'cómo obtener un seguro de carro en Colsubsidio'),
(106, 'cars_fund', 'detalles del seguro automotriz Colsubsidio'),
(107, 'cars_fund', 'solicitar cotización de seguro vehicular Colsubsidio'),
(108, 'cars_fund', 'beneficios del seguro para carros en Colsubsidio'),
(109, 'cars_fund', 'opciones de seguros para autos con Colsubsidio'),
(110, 'motorbikes', 'información seguro moto Colsubsidio'),
(111, 'motorbikes', 'cotización seguro para motos Colsubsidio'),
(112, 'motorbikes', 'quiero asegurar mi moto con Colsubsidio'),
(113, 'motorbikes', 'precio seguro de moto Colsubsidio'),
(114, 'motorbikes', 'cómo obtener seguro para motos en Colsubsidio'),
(115, 'motorbikes', 'detalles del seguro de motos Colsubsidio'),
(116, 'motorbikes', 'solicitar cotización de seguro moto Colsubsidio'),
(117, 'motorbikes', 'beneficios del seguro para motos en Colsubsidio'),
(118, 'motorbikes', 'qué cubre el seguro de moto Colsubsidio')
"""

NORM = """trim(regexp_replace(translate(lower(coalesce({}, '')), 'áéíóúÁÉÍÓÚñÑüÜ', 'aeiouAEIOUnNuU'), '[^a-z0-9]+', ' ', 'g'))"""
#: Every third user turn is followed, that many turns later, by a turn that says a trigger phrase.
INJECT_EVERY, PHRASE_TURN = 3, 100_000

cte("phrases", f"SELECT i, topic, phrase, {NORM.format('phrase')} AS norm FROM (VALUES {ORACLE_PHRASES}) AS ph(i, topic, phrase)")
cte("utterances", f"""
SELECT conv_id, turn, text FROM conversations WHERE role = 'user'
UNION ALL
SELECT conv_id, turn + {PHRASE_TURN}, p.phrase
FROM conversations c JOIN phrases p ON p.i = ((conv_id * 8 + turn) // {INJECT_EVERY}) % (SELECT count(*) FROM phrases)
WHERE role = 'user' AND (conv_id * 8 + turn) % {INJECT_EVERY} = 0""", ["phrases"])
cte("utter", f"SELECT conv_id, turn, {NORM.format('text')} AS norm FROM utterances", ["utterances"])
cte("tagged", """
SELECT u.conv_id, u.turn,
       coalesce(CASE WHEN count(ph.topic) FILTER (WHERE u.norm = ph.norm) > 0
                     THEN list(DISTINCT ph.topic ORDER BY ph.topic) FILTER (WHERE u.norm = ph.norm)
                     ELSE list(DISTINCT ph.topic ORDER BY ph.topic) FILTER (WHERE ph.topic IS NOT NULL) END, CAST([] AS VARCHAR[])) AS topics
FROM utter u LEFT JOIN phrases ph ON contains(' ' || u.norm || ' ', ' ' || ph.norm || ' ')
GROUP BY u.conv_id, u.turn""", ["utter", "phrases"])
cte("intents", """
SELECT conv_id, turn, topics,
       CASE WHEN len(topics) = 0 THEN 'unknown' WHEN len(topics) > 1 THEN 'ambiguous' ELSE topics[1] END AS intent
FROM tagged""", ["tagged"])


def chat_turns(spark, sf_dir):
    """All turns of the conversations, and user turns of their own that say the trigger phrases one by one."""
    phrases = [p for ps in fixed.TOPIC_PHRASES.values() for p in ps]
    turns = read_table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 8 + F.col("turn")
    said = F.get(F.array(*[F.lit(p) for p in phrases]), (F.floor(number / INJECT_EVERY) % len(phrases)).cast("int"))
    more = turns.where((F.col("role") == "user") & (number % INJECT_EVERY == 0)).withColumns({"text": said, "turn": F.col("turn") + PHRASE_TURN})
    return turns.unionByName(more)


@register("intent_tags", "P-06", sql("SELECT conv_id, turn, topics, intent FROM intents", "intents"))
def intent_tags(spark, sf_dir):
    conv = chat_turns(spark, sf_dir).filter(F.col("role") == "user")
    return chat.tag_intents(conv).select("conv_id", "turn", "topics", "intent")


cte("escal", """
SELECT c.conv_id, CAST(coalesce(k.n_unknown, 0) AS BIGINT) AS n_unknown, e.escalation_turn IS NOT NULL AS escalated, e.escalation_turn
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN (SELECT conv_id, count(*) AS n_unknown FROM intents WHERE intent = 'unknown' GROUP BY conv_id) k ON c.conv_id = k.conv_id
LEFT JOIN (SELECT conv_id, turn AS escalation_turn FROM (
             SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM intents WHERE intent = 'unknown') x
           WHERE k = 3) e ON c.conv_id = e.conv_id""", ["intents"])


@register("escalations", "P-07", sql("SELECT * FROM escal", "escal"))
def escalations(spark, sf_dir):
    return chat.escalations(chat_turns(spark, sf_dir))


@register("conversation_outcomes", "A-34", sql("""
SELECT outcome, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 10) AS share FROM (
  SELECT e.conv_id,
         CASE WHEN e.escalated OR coalesce(c.asked, 0) = 1 THEN 'escalated'
              WHEN coalesce(c.closing, 0) = 1 THEN 'resolved_confirmed' ELSE 'resolved_implied' END AS outcome
  FROM escal e LEFT JOIN (
    SELECT conv_id, max(CASE WHEN list_contains(topics, 'thank_you') OR list_contains(topics, 'goodbye') THEN 1 ELSE 0 END) AS closing,
           max(CASE WHEN list_contains(topics, 'escalate') THEN 1 ELSE 0 END) AS asked
    FROM intents GROUP BY conv_id) c ON e.conv_id = c.conv_id) o
GROUP BY outcome""", "escal", "intents"))
def conversation_outcomes(spark, sf_dir):
    o = chat.conversation_outcomes(chat_turns(spark, sf_dir))
    agg = o.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    total = o.agg(F.count(F.lit(1))).scalar()
    return agg.withColumn("share", F.round(F.col("n") / total, 10))


NEEDS = ["Busco un SOAT", "un carro y una moto", "mi perro enferma", "motor", "veterinaria para el gato", "protección para mi mascota", "scooter o patineta"]
cte("needs", """
SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'Busco un SOAT' WHEN 1 THEN 'un carro y una moto' WHEN 2 THEN 'mi perro enferma' WHEN 3 THEN 'motor'
         WHEN 4 THEN 'veterinaria para el gato' WHEN 5 THEN 'protección para mi mascota' WHEN 6 THEN 'scooter o patineta' ELSE '' END || chr(10) || text AS text
FROM documents""")
cte("need_words", f"SELECT doc_id, ' ' || {NORM.format('text')} || ' ' AS n FROM needs", ["needs"])


@register("insurance_suggestions", "P-05", sql("""
SELECT doc_id, list_slice(list_filter(list_distinct_in_order, lambda x: x IS NOT NULL), 1, 2) AS suggestions FROM (
  SELECT doc_id, [
    CASE WHEN regexp_matches(n, ' (bicicleta|bicicletas|patineta|patinetas|scooter|scooters) ') THEN 'Seguro para Bicicleta, Patineta o Scooter' END,
    CASE WHEN regexp_matches(n, ' (soat|seguro obligatorio) ') THEN 'SOAT' END,
    CASE WHEN regexp_matches(n, ' (carro|carros) ') THEN 'Seguro para Carro' END,
    CASE WHEN regexp_matches(n, ' (moto|motos) ') THEN 'Asistencia para Moto' END,
    CASE WHEN regexp_matches(n, ' (perro|gato|mascota|mascotas) ') AND regexp_matches(n, ' (enferma|enferman|enfermo|enfermedad|enfermedades) ')
         THEN 'Medicina Prepagada para Mascotas' END,
    CASE WHEN regexp_matches(n, ' (veterinario|veterinaria|veterinarios|veterinarias) ') THEN 'Asistencia Veterinaria para Mascotas' END,
    CASE WHEN regexp_matches(n, ' (mascota|mascotas) ') THEN 'Seguro para Mascotas' END,
    CASE WHEN regexp_matches(n, ' (mascota|mascotas) ') AND NOT (regexp_matches(n, ' (perro|gato|mascota|mascotas) ')
              AND regexp_matches(n, ' (enferma|enferman|enfermo|enfermedad|enfermedades) ')) THEN 'Medicina Prepagada para Mascotas' END
  ] AS list_distinct_in_order FROM need_words) x""", "need_words"))
def insurance_suggestions(spark, sf_dir):
    k = F.col("doc_id") % 11
    said = F.when(k < len(NEEDS), F.get(F.array(*[F.lit(x) for x in NEEDS]), k.cast("int"))).otherwise(F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(said, F.lit("\n"), F.col("text")).alias("text"))
    return chat.insurance_suggestions(docs, "doc_id")


cte("raw_responses", """
SELECT conv_id, turn,
       CASE (conv_id + turn) % 6
            WHEN 0 THEN CAST(json_object('choices', json_array(json_object('message', json_object('content', text), 'finish_reason', 'stop'))) AS VARCHAR)
            WHEN 1 THEN CAST(json_object('choices', json_array(json_object('message', json_object('content', text), 'finish_reason', 'length'))) AS VARCHAR)
            WHEN 2 THEN '{"choices": []}'
            WHEN 3 THEN text
            WHEN 4 THEN '[1, 2]'
            ELSE '{"choices": [{"message": {"content": "   "}}]}' END AS raw
FROM conversations WHERE role = 'assistant'""")


@register("parse_completions", "F-25", sql("""
SELECT conv_id, turn, code AS error_code, CASE WHEN code IS NULL THEN regexp_replace(content, '^\\s+|\\s+$', '', 'g') END AS content FROM (
  SELECT conv_id, turn, json_extract_string(j, '$.choices[0].message.content') AS content,
         CASE WHEN j IS NULL THEN 'invalid_json'
              WHEN json_type(j) <> 'OBJECT' THEN 'not_object'
              WHEN coalesce(json_type(j, '$.choices'), '') <> 'ARRAY' OR json_array_length(j, '$.choices') = 0 THEN 'no_choices'
              WHEN json_type(j, '$.choices[0]') <> 'OBJECT' THEN 'bad_choice'
              WHEN coalesce(json_type(j, '$.choices[0].message'), '') <> 'OBJECT' THEN 'bad_message'
              WHEN coalesce(json_type(j, '$.choices[0].message.content'), '') <> 'VARCHAR'
                   OR length(regexp_replace(json_extract_string(j, '$.choices[0].message.content'), '^\\s+|\\s+$', '', 'g')) = 0 THEN 'empty'
              WHEN json_extract_string(j, '$.choices[0].finish_reason') = 'length' THEN 'length'
              WHEN json_extract_string(j, '$.choices[0].finish_reason') = 'content_filter' THEN 'content_filter' END AS code
  FROM (SELECT conv_id, turn, CASE WHEN coalesce(json_valid(raw), false) THEN raw END AS j FROM raw_responses) r) x""", "raw_responses"))
def parse_completions(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    k = (F.col("conv_id") + F.col("turn")) % 6
    ok = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"),
                                             F.lit("stop").alias("finish_reason"))).alias("choices")))
    trunc = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"),
                                                F.lit("length").alias("finish_reason"))).alias("choices")))
    raw = (F.when(k == 0, ok).when(k == 1, trunc).when(k == 2, F.lit('{"choices": []}')).when(k == 3, F.col("text"))
           .when(k == 4, F.lit("[1, 2]")).otherwise(F.lit('{"choices": [{"message": {"content": "   "}}]}')))
    return chat.parse_completions(conv.select("conv_id", "turn", raw.alias("raw")), ["conv_id", "turn"])
