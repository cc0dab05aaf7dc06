"""Stored rows, prompts and data capture on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from cauce.operators import capture, prompts, stored_rows


def test_stored_rows_and_back(spark):
    schema = "cedula string, ingresos double, edad int, consent_whatsapp boolean, consent_email boolean, intereses array<string>, momentos_clave array<string>, mora_maxima_historica string"
    rows = [("1", 1234.56, 30, True, False, ["a\"b", "ñ, x"], [], "30_DIAS"), ("2", 0.0, None, False, True, [""], ["[1]"], "0_DIAS"), ("3", 9999999999999.99, -1, True, True, ["{}"], ["\\\n"], "x")]
    persons = spark.createDataFrame(rows, schema)
    stored = stored_rows.to_stored(persons)
    assert dict(stored.dtypes) == {"cedula": "string", "ingresos": "decimal(18,2)", "edad": "int", "consent_whatsapp": "int", "consent_email": "int", "intereses": "string",
                                   "momentos_clave": "string", "mora_maxima_historica": "string"}
    for form in (stored, stored.select(*[F.col(c).cast("string") for c in stored.columns])):
        back = stored_rows.from_stored(form)
        assert sorted(tuple(r) for r in back.drop("errors").collect()) == rows and back.filter(F.size("errors") > 0).count() == 0
        assert back.drop("errors").dtypes == persons.dtypes
    assert stored_rows.from_stored(stored.limit(0)).count() == 0


def test_damaged_and_missing_values(spark):
    rows = [(None, None, None, None, None, "k"), ("abc", "1.5", "2", "{\"a\": 1}", None, "k"), (" 7 ", "99999999999", "true", "[\"a\", 1]", "90_MAS_DIAS", "k"), ("", "8", "0", " ", "", "k")]
    stored = spark.createDataFrame(rows, "ingresos string, num_creditos_activos string, consent_email string, intereses string, mora_maxima_historica string, errors_note string")
    got = [(*r[:6], [(e["field"], e["value"]) for e in r["errors"]]) for r in stored_rows.from_stored(stored).collect()]
    assert got == [
        (None, 0, False, [], "0_DIAS", "k", []),
        (None, None, None, [], "0_DIAS", "k", [("ingresos", "abc"), ("num_creditos_activos", "1.5"), ("consent_email", "2"), ("intereses", "{\"a\": 1}")]),
        (7.0, None, True, ["a", "1"], "90_MAS_DIAS", "k", [("num_creditos_activos", "99999999999")]),
        (None, 8, False, [], "", "k", [("ingresos", "")]),
    ]


def test_prompts(spark):
    rows = [("Ana {x}\n", "P", "whatsapp"), ("  ", "P", "sms"), (None, "P", "sms"), ("Ana", "\n", "email"), ("Ana", "P", "app"), ("Ana", "P", None), ("", "", "app"),
            ("Ana", "P", "email"), ("Ana", "P", "sms"), ("</persona>", "P", "sms")]
    offers = spark.createDataFrame([(i, *r, "R.", "$1", "2%", 36, "$3") for i, r in enumerate(rows)],
                                   "id int, person_name string, product_name string, channel string, reason string, amount_cop string, annual_rate_pct string, term_months int, cuota_cop string")
    got = {r["id"]: r for r in prompts.prompt_table(offers, ["id"]).collect()}
    assert [got[i]["error"] for i in range(len(rows))] == [None, "blank_name", "blank_name", "blank_product", "unknown_channel", "unknown_channel", "blank_name", None, None, None]
    assert all((r["prompt"] is None) != (r["error"] is None) for r in got.values())
    head = "<persona>{}</persona>\n<producto>P</producto>\n<beneficios>R. Monto: $1 · Tasa: 2% · Plazo: 36 meses · Cuota: $3</beneficios>\n\nCrea un mensaje de {} para la persona"
    assert got[0]["prompt"].startswith(head.format("Ana (x)", "WhatsApp")) and got[8]["prompt"].startswith(head.format("Ana", "SMS"))
    assert got[7]["prompt"].endswith("\n\nReglas:\n- 2 a 4 oraciones.\n- Incluye un saludo inicial (ej. 'Hola María,') y una despedida cordial.\n"
                                     "- Más detallado pero manteniendo un tono amigable y cercano.\n- Sin asunto (subject), solo el cuerpo del correo.\n- Solo el texto del mensaje, nada más.")


def _missing(member, answers, lines):
    """Brute force over one member's profile and answers."""
    out = {}
    for line, fields in lines.items():
        said = {}
        for at, field, value in answers:
            if value and value.strip() and at in lines and (at == line or field in capture.OF_MEMBER):
                said.setdefault(field, set()).add(value.strip())
        stored = {f for f, v in member.items() if v and v.strip()}
        out[line] = [f for f in fields if f not in said and f not in stored
                     and (f not in capture.DEPENDENT or capture.DEPENDENT[f][1] in said.get(capture.DEPENDENT[f][0], ()))]
    return out


def test_missing_fields_against_brute_force(spark):
    rng = random.Random(5)
    lines = capture.LINE_FIELDS
    every = sorted({f for fields in lines.values() for f in fields} | {"no_such_field"})
    members = {f"m{i}": {"telefono": rng.choice([None, "", " ", "57"]), "correo": rng.choice([None, "a@b"])} for i in range(40)}
    answers = [(rng.choice([*members, "nobody", None]), rng.choice([*lines, "no_line", None]), rng.choice(every), rng.choice([None, "", "  ", "bicicleta", " bicicleta", "patineta"])) for _ in range(1500)]
    answers += [("m0", "motos", f, "x") for f in lines["motos"]] * 20
    frame = spark.createDataFrame([(m, v["telefono"], v["correo"], "x") for m, v in members.items()], "member_id string, telefono string, mail string, line string")
    told = spark.createDataFrame(answers, "member_id string, line string, field string, value string")
    got = {}
    for r in capture.missing_fields(frame.drop("line"), told, {"telefono": "telefono", "correo": "mail"}).collect():
        got.setdefault(r["member_id"], {})[r["line"]] = list(r["missing"])
        assert r["n_missing"] == len(r["missing"])
    assert got == {m: _missing(v, [a[1:] for a in answers if a[0] == m], lines) for m, v in members.items()}
    assert got["m0"]["motos"] == []
    none = capture.missing_fields(frame.drop("line"), told.limit(0), {}).collect()
    assert {(r["line"], r["n_missing"]) for r in none} == {(line, len([f for f in fields if f not in capture.DEPENDENT])) for line, fields in lines.items()}


@pytest.mark.parametrize("form, expect", [
    (None, []), ("", []), ("[", []), ("{\"vacuna\": \"Rabia\"}", []), ("[]", []), ("[{\"vacuna\": \"Rabia\"}, {\"aplicada\": true}]", []),
    ("[{\"vacuna\": \"Rabia\", \"aplicada\": true}, {\"vacuna\": \" \", \"aplicada\": true}, {\"vacuna\": \"Parvovirus\", \"aplicada\": false}, {\"vacuna\": \" Rabia\", \"aplicada\": true},"
     " {\"vacuna\": \"Moquillo\", \"aplicada\": true, \"x\": 1}]", ["Rabia", "Moquillo"]),
])
def test_applied_items(spark, form, expect):
    frame = spark.createDataFrame([(form,)], "form string")
    assert frame.select(capture.applied_items(F.col("form"), "vacuna", "aplicada")).first()[0] == expect
