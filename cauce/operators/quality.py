"""Data-quality, population and split operators over member tables.

Each check is one aggregation pass producing a small long table (one row
per rule / column), never a per-rule job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cauce import fixed
from cauce.functions.ids import mask_phone

NO_TARGET = "(sin producto)"

# FIXED VALUES: row constraints of the member table (rule id, SQL predicate that must hold)
PERSON_RULES = [
    ("cedula_not_null", "cedula IS NOT NULL"),
    ("nombre_not_null", "nombre IS NOT NULL"),
    ("edad_not_null", "edad IS NOT NULL"),
    ("ingresos_not_null", "ingresos IS NOT NULL"),
    ("consent_flags_not_null", "consent_whatsapp IS NOT NULL AND consent_email IS NOT NULL"),
    ("categoria_in_domain", "categoria_afiliacion IN ('A', 'B', 'C', 'D')"),
    ("mora_in_domain", "mora_maxima_historica IN ('0_DIAS', '30_DIAS', '60_DIAS', '90_MAS_DIAS')"),
    ("edad_in_range", "edad BETWEEN 18 AND 69"),
    ("score_in_range", "score_datacredito BETWEEN 150 AND 950"),
    ("capacidad_in_range", "capacidad_endeudamiento_disponible_pct BETWEEN 5 AND 95"),
    ("creditos_in_range", "num_creditos_activos BETWEEN 0 AND 4"),
    ("income_matches_tier",
     "(categoria_afiliacion = 'A' AND ingresos <= 2847000) OR (categoria_afiliacion = 'B' AND ingresos > 2847000 AND ingresos <= 5694000)"
     " OR (categoria_afiliacion = 'C' AND ingresos > 5694000) OR categoria_afiliacion = 'D'"),
    ("whatsapp_consent_has_phone", "NOT consent_whatsapp OR length(telefono) > 0"),
    ("email_consent_has_mail", "NOT consent_email OR length(correo) > 0"),
    ("target_in_catalog",
     "product_target IS NULL OR product_target IN ('educativo', 'compra_cartera', 'hipotecario', 'libre_inversion', 'cupo_rotativo', 'turismo')"),
]


def rule_violations(df: DataFrame, rules: list[tuple[str, str]] = PERSON_RULES, key: str = "cedula") -> DataFrame:
    """(rule, n_checked, n_violations) for every rule plus key uniqueness, in one pass.

    A rule whose predicate is null (unknown) counts as violated.
    """
    aggs = [F.count_if(~F.coalesce(F.expr(cond), F.lit(False))).alias(f"r{i}") for i, (_, cond) in enumerate(rules)]
    aggs += [F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(key)).alias("n_keys")]
    one = df.agg(*aggs)
    pairs = [F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("n_violations")) for i, (name, _) in enumerate(rules)]
    pairs.append(F.struct(F.lit(f"{key}_unique").alias("rule"), (F.col("n") - F.col("n_keys")).alias("n_violations")))
    return one.select("n", F.inline(F.array(*pairs))).select("rule", F.col("n").alias("n_checked"), "n_violations")


def apply_defaults(persons: DataFrame) -> DataFrame:
    """Column defaults on insert (missing mora, counts, consents)."""
    return (persons
            .withColumn("mora_maxima_historica", F.coalesce("mora_maxima_historica", F.lit("0_DIAS")))
            .withColumn("num_creditos_activos", F.coalesce("num_creditos_activos", F.lit(0)))
            .withColumn("consent_whatsapp", F.coalesce("consent_whatsapp", F.lit(False)))
            .withColumn("consent_email", F.coalesce("consent_email", F.lit(False))))


def missing_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_bad) counting null or NaN per numeric column, one pass."""
    aggs = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c))).alias(f"c{i}") for i, c in enumerate(columns)]
    one = df.agg(*aggs)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_bad")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*pairs)))


def oov_rates(df: DataFrame, vocab: dict[str, list[str]], threshold: float = fixed.OOV_THRESHOLD) -> DataFrame:
    """Out-of-vocabulary share per categorical column; null counts as OOV.

    verdict: reject above the threshold, warn when any value is OOV, else ok.
    """
    cols = list(vocab)
    aggs = [F.count_if(~F.coalesce(F.col(c).isin(*vocab[c]), F.lit(False))).alias(f"o{i}") for i, c in enumerate(cols)]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("n_oov")) for i, c in enumerate(cols)]
    long = one.select("n", F.inline(F.array(*pairs)))
    rate = F.try_divide(F.col("n_oov"), F.col("n"))
    return long.select("column", "n", "n_oov", rate.alias("oov_rate"),
                       F.when(rate > threshold, "reject").when(F.col("n_oov") > 0, "warn").otherwise("ok").alias("verdict"))


def label_vocabularies(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, vocabulary) with the sorted distinct non-null labels of each array column.

    One ``stack``+``explode`` pass over all columns; the distinct step is a
    partial aggregate, so the collected set per column is the vocabulary
    size, not the row count.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("labels")) for c in columns])
    long = df.select(F.inline(pairs)).select("column", F.explode("labels").alias("label")).filter(F.col("label").isNotNull())
    distinct = long.distinct()
    return distinct.groupBy("column").agg(F.array_sort(F.collect_list("label")).alias("vocabulary"))


def population_profile(persons: DataFrame) -> DataFrame:
    """Counts by category, target (null -> '(sin producto)') and worst delinquency."""
    pairs = F.array(
        F.struct(F.lit("categoria_afiliacion").alias("dimension"), F.col("categoria_afiliacion").alias("value")),
        F.struct(F.lit("product_target").alias("dimension"), F.coalesce(F.col("product_target"), F.lit(NO_TARGET)).alias("value")),
        F.struct(F.lit("mora_maxima_historica").alias("dimension"), F.col("mora_maxima_historica").alias("value")),
    )
    return persons.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def top_targets(persons: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent targets (ties by name); the limit is the feature."""
    counts = persons.groupBy(F.coalesce(F.col("product_target"), F.lit(NO_TARGET)).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("target")).limit(k)


def pii_free_profile(persons: DataFrame) -> DataFrame:
    """Member profile without names, contacts, address or birth date."""
    drop = set(fixed.EXCLUDED_COLS) - {"cedula"}
    return persons.select(*[c for c in persons.columns if c not in drop and c != "gender"])


def masked_contacts(persons: DataFrame) -> DataFrame:
    return persons.select("cedula", mask_phone(F.col("telefono")).alias("telefono_masked"))


def row_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free dataset fingerprint: row count and the sum of 52-bit row hashes.

    Per-row SHA-256 of the '|'-joined columns, first 13 hex digits summed as
    a decimal: a partial aggregate, independent of row order and partitioning.
    """
    h = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    v = F.conv(F.substring(h, 1, 13), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(v).cast("decimal(38,0)").cast("string").alias("fingerprint"))


SPLIT_BUCKETS = 4096


def shuffle_key(key: Column, seed: int = fixed.SPLIT_SEED) -> Column:
    """Deterministic pseudo-random order key of any id: the first 52 bits of
    SHA-256 over seed and id text (ids may have letters and any length)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def stratified_split(df: DataFrame, key: str, stratum: str, fractions=fixed.SPLIT_FRACTIONS,
                     seed: int = fixed.SPLIT_SEED) -> DataFrame:
    """Exact-proportion stratified train/valid/test labels, shared by every target.

    Rank r (0-based) inside each stratum in hash order, n = stratum size:
    train if r < f1 n, valid if r < (f1+f2) n, else test (integer arithmetic).
    Only counts per (stratum, hash bucket) are summed up; a bucket that lies
    inside one part needs no ranks, and rows are ranked only in the two buckets
    of a stratum that a cut goes through, so no stratum is sorted as a whole.
    """
    a = int(round(fractions[0] * 10))
    b = int(round((fractions[0] + fractions[1]) * 10))
    hashed = df.withColumn("__h", shuffle_key(F.col(key), seed)).withColumn("__b", F.floor(F.col("__h") / (1 << 40)).cast("int"))
    counts = hashed.groupBy(F.col(stratum).alias("__s"), "__b").agg(F.count(F.lit(1)).alias("__c"))
    every = Window.partitionBy("__s")  # at most SPLIT_BUCKETS rows a stratum
    counts = counts.select("__s", F.col("__b").alias("__k"), "__c", F.sum("__c").over(every).alias("__n"),
                           (F.sum("__c").over(every.orderBy("__b")) - F.col("__c")).alias("__start"))

    def part(rank):
        return F.when(rank * 10 < a * F.col("__n"), "train").when(rank * 10 < b * F.col("__n"), "valid").otherwise("test")

    low, high = part(F.col("__start")), part(F.col("__start") + F.col("__c") - 1)
    counts = counts.withColumn("__whole", F.when(low == high, low))
    joined = hashed.join(counts, hashed[stratum].eqNullSafe(counts["__s"]) & (hashed["__b"] == counts["__k"]))
    inside = joined.filter("__whole IS NOT NULL").withColumn("split", F.col("__whole"))
    within = Window.partitionBy("__s", "__b").orderBy("__h", key)
    cut = joined.filter("__whole IS NULL").withColumn("split", part(F.col("__start") + F.row_number().over(within) - 1))
    return inside.unionByName(cut).select(*df.columns, "split")


def sample_rows(df: DataFrame, key: str, n: int = fixed.SAMPLE_SIZE, seed: int = fixed.SPLIT_SEED) -> DataFrame:
    """Reproducible sample of n rows: smallest hash keys (top-k per partition, then merged)."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def model_input(df: DataFrame, key: str = "member_id", required: list[str] = fixed.NUMERICAL_FEATURES + fixed.CATEGORICAL_FEATURES) -> DataFrame:
    """Key and the contract's features in their fixed order; anything else (targets,
    gender, personal data) is left out. Missing features are refused by name."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return df.select(key, *required)


def rejected_input(df: DataFrame, vocab: dict[str, list[str]], key: str = "member_id", numeric: list[str] = fixed.NUMERICAL_FEATURES) -> DataFrame:
    """(key, missing, unknown): members whose input cannot be scored as it is, with
    their null or NaN numbers (these reject) and their categories outside the
    vocabulary (null too; these are warnings), both in contract order."""
    names = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(c)) for c, t in tests]))
    missing = names([(c, F.col(c).isNull() | F.isnan(F.col(c))) for c in numeric])
    unknown = names([(c, ~F.coalesce(F.col(c).isin(*vs), F.lit(False))) for c, vs in vocab.items()])
    return df.select(key, missing.alias("missing"), unknown.alias("unknown")).where((F.size("missing") > 0) | (F.size("unknown") > 0))
