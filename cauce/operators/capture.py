"""Insurance data capture: what is still to be asked (P-08), applied items of JSON forms (F-33)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: what each line of insurance needs, in the order it is asked
CONTACT = ["nombre", "telefono", "correo", "departamento", "municipio"]
VEHICLE = ["placa", "marca", "anio_modelo", "linea", "cilindraje", "cero_km", "endoso"]
LINE_FIELDS = {
    "carros": [*CONTACT, *VEHICLE],
    "motos": [*CONTACT, *VEHICLE],
    "bicicletas_patinetas": [*CONTACT, "fecha_nacimiento", "fecha_expedicion", "tipo_activo", "tipo_bicicleta", "marca", "linea", "anio_modelo", "fecha_compra",
                             "valor_comercial", "valor_accesorios"],
    "mascotas": ["nombre", "fecha_nacimiento", "fecha_expedicion", "ocupacion", "salario", "profesion", "telefono", "correo", "nombre_mascota", "tipo_mascota",
                 "edad_mascota", "color", "raza", "peso", "vacunas", "enfermedades"],
}
#: Asked only after another field has this answer: field -> (other field, answer).
DEPENDENT = {"tipo_bicicleta": ("tipo_activo", "bicicleta")}
#: Fields of the member, not of an insured thing: an answer for one line counts for all.
OF_MEMBER = sorted({*CONTACT, "fecha_nacimiento", "fecha_expedicion", "ocupacion", "salario", "profesion"})


def _present(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def missing_fields(members: DataFrame, answers: DataFrame, profile: dict[str, str], key: str = "member_id", lines: dict[str, list[str]] = LINE_FIELDS) -> DataFrame:
    """(key, line, missing, n_missing): per member and line the fields to ask for, in order.

    A field is not asked for when the profile (``profile``: field -> column of
    ``members``) or an answer (key, line, field, value) holds a value that is
    not blank. ``DEPENDENT`` fields are asked for once their condition is
    answered so. Answers of unknown members, lines or fields do not count. A
    member's answers shrink to one entry per line and field before they meet
    the members, so any number of them costs one row of bounded size.
    """
    known = [f"{line}|{f}" for line, fields in lines.items() for f in fields] + [f"*|{f}" for f in OF_MEMBER]
    conditions = {f"{line}|{f}": v for line, fields in lines.items() for dep, (f, v) in DEPENDENT.items() if dep in fields}
    scope = F.when(F.col("field").isin(OF_MEMBER), F.lit("*")).otherwise(F.col("line"))
    name = F.concat_ws("|", scope, F.col("field"))
    met = F.lit(False)
    for k, v in conditions.items():
        met = met | ((name == k) & (F.trim("value") == v))
    told = answers.filter(_present(F.col("value")) & F.col("line").isin(list(lines))).select(key, F.explode(F.array_compact(F.array(name, F.when(met, F.concat(name, F.lit("="))))) ).alias("__has"))
    told = told.filter(F.rtrim(F.col("__has"), F.lit("=")).isin(known)).distinct().groupBy(key).agg(F.collect_set("__has").alias("__has"))
    stored = F.array_compact(F.array(*[F.when(_present(F.col(c)), F.lit(f"*|{f}")) for f, c in profile.items()]))
    joined = members.join(told, key, "left").withColumn("__all", F.array_union(stored, F.coalesce("__has", F.array().cast("array<string>"))))

    def asked(line: str) -> Column:
        def one(f: str) -> Column:
            need = ~F.array_contains("__all", f"*|{f}" if f in OF_MEMBER else f"{line}|{f}")
            if f in DEPENDENT:
                need = need & F.array_contains("__all", f"{line}|{DEPENDENT[f][0]}=")
            return F.when(need, F.lit(f))
        return F.struct(F.lit(line).alias("line"), F.array_compact(F.array(*[one(f) for f in lines[line]])).alias("missing"))

    out = joined.select(key, F.inline_outer(F.array(*[asked(line) for line in lines])))
    return out.withColumn("n_missing", F.size("missing").cast("long"))


def applied_items(form: Column, name: str, flag: str) -> Column:
    """Names whose flag is true in a JSON array of {name, flag}, in order, blank
    and repeated names left out; null, malformed or other JSON gives none."""
    items = F.from_json(form, f"array<struct<`{name}`:string,`{flag}`:boolean>>")
    named = F.transform(F.filter(items, lambda x: x[flag] & _present(x[name])), lambda x: F.trim(x[name]))
    return F.coalesce(F.array_distinct(named), F.array().cast("array<string>"))
