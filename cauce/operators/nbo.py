"""Full next-best-offer decision over the member table.

risk gate -> eligibility (first failing rule recorded) -> payment capacity
-> expected value -> ranking -> channel, window, timing. A member is one row
throughout: the catalog is an array literal (a few products), its rules are an
array expression over it, and ranking sorts that array, so neither products
nor ranks cost a join or a shuffle. A rule whose input is missing (null or
NaN) fails, and so does the gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cauce import fixed
from cauce.functions.channel import affinity_band, allowed_channels
from cauce.functions.money import amount_for_instalment, instalment

CATALOG_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType(), False),
    T.StructField("margin", T.DoubleType(), False),
    T.StructField("annual_rates", T.MapType(T.StringType(), T.DoubleType()), False),
    T.StructField("term_months", T.IntegerType(), False),
    T.StructField("min_amount_smmlv", T.DoubleType(), False),
    T.StructField("max_amount_smmlv", T.DoubleType(), False),
    T.StructField("allowed_categories", T.ArrayType(T.StringType()), False),
    T.StructField("min_age", T.IntegerType(), False),
    T.StructField("max_age", T.IntegerType(), False),
    T.StructField("min_internal_score", T.DoubleType(), False),
    T.StructField("requires_no_delinquency", T.BooleanType(), False),
    T.StructField("gender_restriction", T.StringType(), True),
    T.StructField("prerequisite_product", T.StringType(), True),
])


def product_catalog(spark: SparkSession) -> DataFrame:
    """The product catalog as a DataFrame (eight rows; safe to broadcast)."""
    rows = []
    for (pid, margin, (ra, rb, rc), term, mn, mx, cats, amin, amax, score, nodel, gender, prereq) in fixed.PRODUCT_CATALOG:
        rows.append((pid, margin, {"A": ra, "B": rb, "C": rc}, term, mn, mx, cats, amin, amax, score, nodel, gender, prereq))
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def catalog_rates(spark: SparkSession) -> DataFrame:
    """(product_id, category, annual_rate) view of the catalog."""
    cat = product_catalog(spark)
    return cat.select("product_id", F.explode("annual_rates").alias("category", "annual_rate"))


def risk_tier(pd_col) -> F.Column:
    """low, medium, high; a missing PD is unknown and gets no offer."""
    return (F.when(pd_col <= fixed.PD_LOW_RISK, "low").when(pd_col <= fixed.PD_HIGH_RISK, "medium")
            .when(pd_col > fixed.PD_HIGH_RISK, "high").otherwise("unknown"))


_INPUTS = ["age", "job_tenure_months", "internal_score", "current_delinquency", "has_mortgage", "income", "debt_ratio", "pd"]


def catalog_literal(entries: list[tuple]) -> F.Column:
    """The catalog as a constant array of structs (folded once by the optimizer)."""
    def entry(e):
        (pid, margin, (ra, rb, rc), term, mn, mx, cats, amin, amax, score, nodel, gender, prereq) = e
        smmlv = float(fixed.SMMLV_COP)
        values = {"product_id": pid, "margin": margin, "rate_a": ra, "rate_b": rb, "rate_c": rc, "term": term, "least": mn * smmlv, "most": mx * smmlv,
                  "min_age": float(amin), "max_age": float(amax), "min_score": score, "no_delinquency": nodel}
        columns = [F.lit(v).alias(k) for k, v in values.items()]
        return F.struct(*columns, F.array(*[F.lit(c) for c in cats]).alias("categories"), F.lit(gender).cast("string").alias("gender"),
                        F.lit(prereq).cast("string").alias("prerequisite"))
    return F.array(*[entry(e) for e in entries])


def _capped(c: F.Column) -> F.Column:
    """Catalog entry ``c`` with the member's rate and the amount all caps leave."""
    category = F.col("category")
    rate = F.when(category == "A", c["rate_a"]).when(category == "B", c["rate_b"]).when(category == "C", c["rate_c"])
    repaid = amount_for_instalment(F.col("__capacity"), rate, c["term"])
    return F.struct(c.alias("entry"), rate.alias("rate"), F.when(repaid.isNotNull(), F.least(repaid, F.col("__limit"), c["most"])).alias("capped"))


def _judged(s: F.Column) -> F.Column:
    """Adds the first rule that fails and the amount offered to ``_capped``."""
    c, capped = s["entry"], s["capped"]
    holds = lambda cond: F.coalesce(cond, F.lit(False))
    need = F.when(F.col("contract_type") == "indefinido", fixed.TENURE_MONTHS_INDEFINITE).otherwise(fixed.TENURE_MONTHS_OTHER)
    rules = [
        ("category", F.array_contains(c["categories"], F.col("category"))),
        ("age", F.col("age").between(c["min_age"], c["max_age"])),
        ("job_tenure", F.col("job_tenure_months") >= need),
        ("score", F.col("internal_score") >= c["min_score"]),
        ("delinquency", ~c["no_delinquency"] | (F.col("current_delinquency") == 0)),
        ("gender", c["gender"].isNull() | (F.col("gender") == c["gender"])),
        ("prerequisite", (F.coalesce(c["prerequisite"], F.lit("")) != "mortgage") | (F.col("has_mortgage") == 1)),
        ("capacity", capped >= c["least"]),
    ]
    reason = F.coalesce(*[F.when(~holds(rule), F.lit(name)) for name, rule in rules])
    halved = F.greatest(capped * fixed.AMOUNT_REDUCTION_FACTOR, c["least"])
    amount = F.when(capped.isNotNull(), F.when(F.col("risk_tier") == "medium", halved).otherwise(capped))
    return F.struct(c.alias("entry"), s["rate"].alias("rate"), reason.alias("reason"), amount.alias("amount"),
                    F.try_element_at(F.col("p_accept"), c["product_id"]).alias("accepts"))


def _offer(s: F.Column) -> F.Column:
    """The offer of one judged entry, with instalment and expected value."""
    c, amount = s["entry"], s["amount"]
    ev = s["accepts"] * (amount / float(fixed.SMMLV_COP)) * (c["margin"] - F.col("pd") * fixed.LGD)
    gated = F.col("risk_tier").isin("low", "medium")
    return F.struct(c["product_id"].alias("product_id"), s["accepts"].alias("p_accept"), s["reason"].alias("ineligible_reason"), c["term"].alias("term_months"),
                    s["rate"].alias("annual_rate"), amount.alias("amount"), instalment(amount, s["rate"], c["term"]).alias("instalment"),
                    F.when(s["reason"].isNull() & gated, ev).alias("ev"))


def evaluate_members(members: DataFrame, catalog: list[tuple] | None = None) -> DataFrame:
    """Adds ``risk_tier`` and ``offers`` (one struct per catalog entry: reason,
    amount, instalment, EV) to each member.

    ``members``: member_id, category, age, job_tenure_months, contract_type,
    internal_score, current_delinquency, gender, has_mortgage, income,
    debt_ratio, pd, p_accept (map product -> calibrated propensity).
    ``catalog``: entries as in ``fixed.PRODUCT_CATALOG``; a literal, so its
    size is that of the plan's text.
    """
    clean = members.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in _INPUTS})
    income = F.col("income")
    limit = income * fixed.MAX_AMOUNT_INCOME_MULTIPLE
    gated = clean.withColumns({
        "risk_tier": risk_tier(F.col("pd")),
        "__capacity": income * (F.lit(1.0) - F.col("debt_ratio")) * fixed.DISPOSABLE_INCOME_SHARE,
        "__limit": F.when(income <= float(fixed.SMMLV_COP), F.least(limit, F.lit(fixed.LOW_INCOME_AMOUNT_CAP))).otherwise(limit)})
    # each step is an array of its own, so a lambda computes a shared term once
    judged = F.transform(F.transform(catalog_literal(catalog or fixed.PRODUCT_CATALOG), _capped), _judged)
    return gated.withColumn("offers", F.transform(judged, _offer)).drop("__capacity", "__limit")


def evaluate_products(evaluated: DataFrame) -> DataFrame:
    """One row per (member, product) of ``evaluate_members``. The outer form
    keeps Spark from inferring a filter on the array, which would compute it twice."""
    return evaluated.select("member_id", "pd", "risk_tier", F.inline_outer("offers")).filter(F.col("product_id").isNotNull())


def with_ranking(evaluated: DataFrame, top_n: int = 3) -> DataFrame:
    """Adds ``ranked``: eligible offers with EV above the threshold by EV
    descending (product id breaks ties), at most ``top_n`` (the feature)."""
    candidates = F.filter("offers", lambda o: o["ev"] > fixed.MIN_EV_THRESHOLD)
    keyed = F.transform(candidates, lambda o: F.struct((-o["ev"]).alias("order"), o["product_id"].alias("product_id"), o.alias("offer")))
    return evaluated.withColumn("ranked", F.slice(F.transform(F.sort_array(keyed), lambda k: k["offer"]), 1, top_n))


def rank_offers(ranked: DataFrame) -> DataFrame:
    """One row per ranked offer: rank 1 is the primary one. Outer for the same
    reason as in ``evaluate_products``; members without an offer go afterwards."""
    out = ranked.select("member_id", "pd", "risk_tier", F.posexplode_outer("ranked").alias("place", "o")).filter(F.col("place").isNotNull())
    return out.select("member_id", "pd", "risk_tier", (F.col("place") + 1).alias("rank"), "o.*",
                      F.when(F.col("place") == 0, "primary").otherwise("alternative").alias("role"))


def decisions(ranked: DataFrame) -> DataFrame:
    """One row per member: tier, primary product, alternatives, decline reason."""
    primary = F.get("ranked", F.lit(0))["product_id"]
    return ranked.select(
        "member_id", "risk_tier", primary.alias("primary_product"),
        F.transform(F.slice("ranked", 2, 100), lambda o: o["product_id"]).alias("alternatives"),
        F.when(primary.isNull(), F.when(F.col("risk_tier") == "high", "financial_education")
               .when(F.col("risk_tier") == "unknown", "missing_risk_score").otherwise("no_eligible_offer")).alias("decline_reason"))


def segment() -> F.Column:
    """Affinity band x category of a member."""
    return F.concat_ws("|", affinity_band(F.col("digital_affinity")), F.col("category"))


def _segment_counts(interactions: DataFrame, members: DataFrame, by: list[str]) -> DataFrame:
    """Sends and accepts per segment and ``by``. Interactions are counted per
    member first (map-side combined), so the join moves one row per member and
    combination, however many interactions a member has."""
    per = interactions.groupBy("member_id", *by).agg(
        F.count(F.lit(1)).alias("sends"), F.count_if(F.col("outcome") == "accepted").alias("accepts"))
    joined = per.join(members.select("member_id", segment().alias("segment")), "member_id")
    return joined.groupBy("segment", *by).agg(F.sum("sends").alias("sends"), F.sum("accepts").alias("accepts"))


def global_rate(interactions: DataFrame) -> F.Column:
    return interactions.agg(F.avg((F.col("outcome") == "accepted").cast("double"))).scalar()


def channel_rates(interactions: DataFrame, members: DataFrame, alpha: int = fixed.BAYES_ALPHA) -> DataFrame:
    """Smoothed accept rate per (segment, channel):
    (accepts + alpha * global rate) / (sends + alpha)."""
    counts = _segment_counts(interactions, members, ["channel"])
    return counts.withColumn("rate", (F.col("accepts") + F.lit(alpha) * global_rate(interactions)) / (F.col("sends") + F.lit(alpha)))


def best_windows(interactions: DataFrame, members: DataFrame, alpha: int = fixed.BAYES_ALPHA) -> DataFrame:
    """Best contact window per (segment, channel) by smoothed rate (window name breaks ties)."""
    counts = _segment_counts(interactions, members, ["channel", "contact_window"])
    rated = counts.withColumn("rate", (F.col("accepts") + F.lit(alpha) * global_rate(interactions)) / (F.col("sends") + F.lit(alpha)))
    best = rated.groupBy("segment", "channel").agg(F.min(F.struct((-F.col("rate")).alias("order"), "contact_window", "sends", "accepts", "rate")).alias("b"))
    return best.select("segment", "channel", "b.contact_window", "b.sends", "b.accepts", "b.rate")


def _as_map(table: DataFrame, value: str) -> F.Column:
    """'segment|channel' -> value as one map: at most segments x channels
    entries (bands x categories x six channels, fixed domains)."""
    entry = F.struct(F.concat_ws("|", "segment", "channel").alias("k"), F.col(value).alias("v"))
    return table.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def member_channels(members: DataFrame, rates: DataFrame, prior: F.Column, windows: DataFrame | None = None) -> DataFrame:
    """Adds segment, channel, rate (and contact_window) to each member: the best
    rate among the channels consent allows, channel name breaking ties. A
    segment and channel without sends has the prior, the formula's limit."""
    known = members.withColumns({
        "segment": segment(), "__rates": _as_map(rates, "rate"), "__prior": prior,
        "__allowed": allowed_channels(F.col("consent_whatsapp"), F.col("has_phone"), F.col("consent_email"), F.col("has_email"))})
    options = F.transform("__allowed", lambda c: F.struct(
        (-F.coalesce(F.try_element_at(F.col("__rates"), F.concat_ws("|", F.col("segment"), c)), F.col("__prior"))).alias("order"), c.alias("channel")))
    known = known.withColumn("__best", F.array_min(options))
    known = known.withColumns({"channel": F.col("__best.channel"), "rate": -F.col("__best.order")})
    if windows is not None:
        key = F.concat_ws("|", "segment", "channel")
        known = known.withColumn("contact_window", F.try_element_at(_as_map(windows, "contact_window"), key))
    return known.drop("__rates", "__prior", "__allowed", "__best")


def seasonal_products(monthly: DataFrame, current_month: F.Column, ratio: float = fixed.SEASONALITY_RATIO) -> DataFrame:
    """Busiest month of each product against the current one (no rows there
    count as 0); applies from ``ratio`` times. ``monthly``: product_id, month, n."""
    per = monthly.groupBy("product_id").agg(
        F.min(F.struct((-F.col("n")).alias("order"), "month")).alias("top"),
        F.coalesce(F.sum(F.when(F.col("month") == current_month, F.col("n"))), F.lit(0)).alias("current_n"))
    out = per.select("product_id", F.col("top.month").alias("top_month"), (-F.col("top.order")).alias("top_n"), "current_n")
    return out.select("*", F.try_divide("top_n", "current_n").alias("ratio"), (F.col("top_n") >= ratio * F.col("current_n")).alias("applies"))


def timing() -> F.Column:
    """Timing of the contact, by priority: life event, new member, cleared
    credit, season of the primary product, at once. Missing values do not apply."""
    recent = lambda c, n: F.coalesce(F.col(c) <= n, F.lit(False))
    cleared = recent("months_since_last_credit", fixed.RECENT_CREDIT_MONTHS) & F.coalesce(F.col("active_credit") == 0, F.lit(False))
    return (F.when(recent("months_since_event", fixed.LIFE_EVENT_MONTHS), "life_event")
            .when(recent("tenure_months", fixed.NEW_MEMBER_MONTHS), "new_member")
            .when(cleared, "cleared_credit")
            .when(F.coalesce(F.col("in_season"), F.lit(False)), "seasonality").otherwise(fixed.DEFAULT_TRIGGER))
