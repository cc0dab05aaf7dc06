"""Next-best-offer decision, channel scorer and backtest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce import fixed
from cauce.functions import money
from cauce.operators import nbo, reasons
from cauce.plans.oracle import cte, pick, sql
from cauce.plans.registry import register
from cauce.sources import derived
from cauce.sources.tables import read_table

DIGITS = 10


def _catalog_values() -> str:
    rows = []
    for idx, (pid, margin, (ra, rb, rc), term, mn, mx, cats, amin, amax, score, nodel, gender, prereq) in enumerate(fixed.PRODUCT_CATALOG):
        cats_sql = "[" + ", ".join(f"'{c}'" for c in cats) + "]"
        g = f"'{gender}'" if gender else "NULL"
        pr = f"'{prereq}'" if prereq else "NULL"
        rows.append(f"('{pid}', {margin}, {ra}, {rb}, {rc}, {term}, {mn}, {mx}, {cats_sql}, {amin}, {amax}, {score}, {str(nodel).upper()}, {g}, {pr}, {idx})")
    return ("SELECT col0 AS product_id, CAST(col1 AS DOUBLE) AS margin, CAST(col2 AS DOUBLE) AS rate_a, CAST(col3 AS DOUBLE) AS rate_b,"
            " CAST(col4 AS DOUBLE) AS rate_c, col5 AS term_months, CAST(col6 AS DOUBLE) AS min_amount_smmlv,"
            " CAST(col7 AS DOUBLE) AS max_amount_smmlv, col8 AS allowed_categories, col9 AS min_age, col10 AS max_age,"
            " CAST(col11 AS DOUBLE) AS min_internal_score, col12 AS requires_no_delinquency, CAST(col13 AS VARCHAR) AS gender_restriction,"
            " CAST(col14 AS VARCHAR) AS prerequisite_product, CAST(col15 AS BIGINT) AS idx FROM (VALUES " + ", ".join(rows) + ")")


cte("catalog", _catalog_values())
cte("holdings", """
SELECT o_custkey, count(*) AS n_orders, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS n_pending,
       max(CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS has_mortgage
FROM orders GROUP BY o_custkey""")
cte("members", f"""
SELECT CAST(100000000 + c_custkey AS VARCHAR) AS member_id,
       CASE WHEN 1400000 + (c_custkey * 7919 % 9000) * 1000 <= 2847000 THEN 'A'
            WHEN 1400000 + (c_custkey * 7919 % 9000) * 1000 <= 5694000 THEN 'B' ELSE 'C' END AS category,
       CAST(18 + c_custkey * 31 % 52 AS DOUBLE) AS age,
       CAST(1400000 + (c_custkey * 7919 % 9000) * 1000 AS DOUBLE) AS income,
       CAST(c_custkey * 7 % 120 AS DOUBLE) AS job_tenure_months,
       {pick('c_custkey', 3, ['indefinido', 'fijo', 'prestacion'])} AS contract_type,
       CAST(c_custkey * 17 % 801 AS DOUBLE) / 800 AS internal_score,
       CAST(c_custkey * 11 % 60 AS DOUBLE) / 100 AS debt_ratio,
       CASE WHEN c_custkey % 100 >= 94 THEN 1.0 ELSE 0.0 END AS current_delinquency,
       CAST(coalesce(h.has_mortgage, 0) AS DOUBLE) AS has_mortgage,
       CAST(c_custkey * 29 % 101 AS DOUBLE) AS digital_affinity,
       CAST(c_custkey * 3 % 36 AS DOUBLE) AS months_since_event,
       CAST(c_custkey % 4 AS DOUBLE) AS dependents,
       CAST(coalesce(h.n_orders, 0) AS DOUBLE) AS n_orders,
       CAST(coalesce(h.n_pending, 0) AS DOUBLE) AS n_pending,
       CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
       c_custkey % 100 < 62 AS consent_whatsapp, c_custkey % 7 <> 0 AS has_phone,
       c_custkey % 25 < 12 AS consent_email, (c_custkey % 11 <> 0 AND c_custkey % 11 <> 5) AS has_email
FROM customer LEFT JOIN holdings h ON c_custkey = h.o_custkey""", ["holdings"])
cte("gap_members", """
SELECT * REPLACE (
    CASE WHEN k % 97 = 0 THEN NULL ELSE age END AS age, CASE WHEN k % 89 = 0 THEN NULL ELSE income END AS income,
    CASE WHEN k % 83 = 0 THEN NULL ELSE job_tenure_months END AS job_tenure_months, CASE WHEN k % 79 = 0 THEN NULL ELSE internal_score END AS internal_score,
    CASE WHEN k % 101 = 0 THEN NULL ELSE debt_ratio END AS debt_ratio, CASE WHEN k % 103 = 0 THEN NULL ELSE category END AS category,
    CASE WHEN k % 71 = 0 THEN NULL ELSE contract_type END AS contract_type, CASE WHEN k % 73 = 0 THEN NULL ELSE current_delinquency END AS current_delinquency,
    CASE WHEN k % 67 = 0 THEN NULL ELSE has_mortgage END AS has_mortgage, CASE WHEN k % 61 = 0 THEN NULL ELSE gender END AS gender),
  CASE WHEN k % 59 <> 0 THEN (n_pending + 1.0) / (n_orders + 6.0) * 0.5 END AS pd,
  CAST(k * 19 % 40 AS DOUBLE) AS tenure_months, k % 3 AS active_credit, k * 5 % 48 AS months_since_last_credit
FROM (SELECT *, CAST(member_id AS BIGINT) - 100000000 AS k FROM members) m""", ["members"])
cte("evaluated", """
SELECT *, CASE WHEN ineligible_reason IS NULL AND risk_tier IN ('low', 'medium')
               THEN p_accept * (amount / CAST(1423500 AS DOUBLE)) * (margin - pd * 0.45) END AS ev,
          amount * i / (1 - pow(1 + i, -term_months)) AS instalment
FROM (
  SELECT member_id, product_id, p_accept, pd, margin, term_months, risk_tier, annual_rate, i,
         -- a missing input fails its rule
         CASE WHEN category IS NULL OR NOT list_contains(allowed_categories, category) THEN 'category'
              WHEN age IS NULL OR age < min_age OR age > max_age THEN 'age'
              WHEN job_tenure_months IS NULL OR job_tenure_months < CASE WHEN contract_type = 'indefinido' THEN 2 ELSE 6 END THEN 'job_tenure'
              WHEN internal_score IS NULL OR internal_score < min_internal_score THEN 'score'
              WHEN requires_no_delinquency AND (current_delinquency IS NULL OR current_delinquency <> 0) THEN 'delinquency'
              WHEN gender_restriction IS NOT NULL AND (gender IS NULL OR gender <> gender_restriction) THEN 'gender'
              WHEN prerequisite_product = 'mortgage' AND (has_mortgage IS NULL OR has_mortgage <> 1) THEN 'prerequisite'
              WHEN capped IS NULL OR capped < min_amount_smmlv * 1423500 THEN 'capacity' END AS ineligible_reason,
         CASE WHEN capped IS NULL THEN NULL
              WHEN risk_tier = 'medium' THEN greatest(capped * 0.5, min_amount_smmlv * 1423500) ELSE capped END AS amount
  FROM (
    SELECT *, CASE WHEN income <= 1423500 THEN least(capped0, 1500000.0) ELSE capped0 END AS capped
    FROM (
      SELECT *, CASE WHEN income IS NOT NULL AND debt_ratio IS NOT NULL AND i IS NOT NULL
                     THEN least(income * (1 - debt_ratio) * 0.30 * (1 - pow(1 + i, -term_months)) / i, income * 3.0, max_amount_smmlv * 1423500) END AS capped0
      FROM (
        SELECT m.*, c.*, CAST((m.k * (2 * c.idx + 3) + 17 * c.idx) % 50 AS DOUBLE) / 100 AS p_accept,
               CASE m.category WHEN 'A' THEN c.rate_a WHEN 'B' THEN c.rate_b WHEN 'C' THEN c.rate_c END AS annual_rate,
               pow(1 + CASE m.category WHEN 'A' THEN c.rate_a WHEN 'B' THEN c.rate_b WHEN 'C' THEN c.rate_c END, CAST(1 AS DOUBLE) / 12) - 1 AS i,
               CASE WHEN m.pd <= 0.10 THEN 'low' WHEN m.pd <= 0.20 THEN 'medium' WHEN m.pd > 0.20 THEN 'high' ELSE 'unknown' END AS risk_tier
        FROM gap_members m, catalog c) a) b) c) d""",
    ["catalog", "gap_members"])
cte("ranked", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY ev DESC, product_id) AS "rank"
               FROM evaluated WHERE ev > 0) r WHERE "rank" <= 3""", ["evaluated"])


def _evaluated(spark, sf_dir):
    return nbo.evaluate_members(derived.decision_members(spark, sf_dir))


def _ranked(spark, sf_dir):
    return nbo.with_ranking(_evaluated(spark, sf_dir))


@register("nbo_eligibility", "J-06, J-13, F-09, F-10, F-11, F-13", sql(f"""
SELECT member_id, product_id, risk_tier, ineligible_reason,
       CAST(round(amount) AS BIGINT) AS amount, CAST(round(instalment) AS BIGINT) AS instalment, round(ev, {DIGITS}) + 0.0 AS ev
FROM evaluated""", "evaluated"))
def nbo_eligibility(spark, sf_dir):
    ev = nbo.evaluate_products(_evaluated(spark, sf_dir))
    return ev.select("member_id", "product_id", "risk_tier", "ineligible_reason",
                     F.round("amount").cast("bigint").alias("amount"), F.round("instalment").cast("bigint").alias("instalment"),
                     F.round("ev", DIGITS).alias("ev"))


@register("nbo_ranked_offers", "F-12, W-02", sql(f"""
SELECT member_id, product_id, CAST("rank" AS INTEGER) AS "rank", CASE WHEN "rank" = 1 THEN 'primary' ELSE 'alternative' END AS role,
       risk_tier, CAST(round(amount) AS BIGINT) AS amount, round(ev, {DIGITS}) AS ev
FROM ranked""", "ranked"))
def nbo_ranked_offers(spark, sf_dir):
    r = nbo.rank_offers(_ranked(spark, sf_dir))
    return r.select("member_id", "product_id", "rank", "role", "risk_tier",
                    F.round("amount").cast("bigint").alias("amount"), F.round("ev", DIGITS).alias("ev"))


cte("decided", """
SELECT m.member_id, CASE WHEN m.pd <= 0.10 THEN 'low' WHEN m.pd <= 0.20 THEN 'medium' WHEN m.pd > 0.20 THEN 'high' ELSE 'unknown' END AS risk_tier,
       p.primary_product, coalesce(p.alternatives, CAST([] AS VARCHAR[])) AS alternatives
FROM gap_members m
LEFT JOIN (SELECT member_id, max(CASE WHEN "rank" = 1 THEN product_id END) AS primary_product,
                  coalesce(list(product_id ORDER BY "rank") FILTER (WHERE "rank" > 1), CAST([] AS VARCHAR[])) AS alternatives
           FROM ranked GROUP BY member_id) p ON m.member_id = p.member_id""", ["gap_members", "ranked"])


@register("nbo_decisions", "P-04, W-02", sql("""
SELECT member_id, risk_tier, primary_product, alternatives,
       CASE WHEN primary_product IS NULL THEN CASE risk_tier WHEN 'high' THEN 'financial_education' WHEN 'unknown' THEN 'missing_risk_score'
            ELSE 'no_eligible_offer' END END AS decline_reason
FROM decided""", "decided"))
def nbo_decisions(spark, sf_dir):
    return nbo.decisions(_ranked(spark, sf_dir))


cte("interactions", f"""
SELECT event_id AS interaction_id, CAST(100000000 + user_id AS VARCHAR) AS member_id,
       {pick('event_id', 8, [p[0] for p in fixed.PRODUCT_CATALOG])} AS product_id,
       {pick('event_id', 6, fixed.CHANNELS)} AS channel, ts AS contacted_at,
       CASE WHEN hour(ts) < 11 THEN 'morning' WHEN hour(ts) < 14 THEN 'midday' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'night' END AS contact_window,
       CASE WHEN event_type = 'purchase' THEN 'accepted' WHEN event_type IN ('view', 'click') THEN 'ignored' ELSE 'rejected' END AS outcome
FROM events""")
cte("segmented", """
SELECT i.*, (CASE WHEN m.digital_affinity >= 70 THEN 'high' WHEN m.digital_affinity >= 45 THEN 'medium' ELSE 'low' END) || '|' || m.category AS segment
FROM interactions i JOIN members m ON i.member_id = m.member_id""", ["interactions", "members"])
cte("prior", "SELECT avg(CAST(outcome = 'accepted' AS DOUBLE)) AS g FROM interactions", ["interactions"])
cte("chan_rates", """
SELECT segment, channel, CAST(count(*) AS BIGINT) AS sends, CAST(count(*) FILTER (WHERE outcome = 'accepted') AS BIGINT) AS accepts,
       (count(*) FILTER (WHERE outcome = 'accepted') + 50 * (SELECT avg(CAST(outcome = 'accepted' AS DOUBLE)) FROM interactions)) / (count(*) + 50) AS rate
FROM segmented GROUP BY segment, channel""", ["segmented", "interactions"])


@register("channel_rates", "A-20, W-14", sql(f"""
SELECT segment, channel, sends, accepts, round(rate, {DIGITS}) AS rate FROM chan_rates""", "chan_rates"))
def channel_rates(spark, sf_dir):
    r = nbo.channel_rates(derived.interactions(spark, sf_dir), derived.member_features(spark, sf_dir))
    return r.withColumn("rate", F.round("rate", DIGITS))


@register("best_windows", "A-21, W-05", sql(f"""
SELECT segment, channel, contact_window, sends, accepts, round(rate, {DIGITS}) AS rate FROM (
  SELECT *, row_number() OVER (PARTITION BY segment, channel ORDER BY rate DESC, contact_window) AS r FROM (
    SELECT segment, channel, contact_window, CAST(count(*) AS BIGINT) AS sends,
           CAST(count(*) FILTER (WHERE outcome = 'accepted') AS BIGINT) AS accepts,
           (count(*) FILTER (WHERE outcome = 'accepted') + 50 * (SELECT avg(CAST(outcome = 'accepted' AS DOUBLE)) FROM interactions)) / (count(*) + 50) AS rate
    FROM segmented GROUP BY segment, channel, contact_window) a) b WHERE r = 1""", "segmented", "interactions"))
def best_windows(spark, sf_dir):
    r = nbo.best_windows(derived.interactions(spark, sf_dir), derived.member_features(spark, sf_dir))
    return r.withColumn("rate", F.round("rate", DIGITS))


cte("member_channel", """
SELECT member_id, segment, channel, rate FROM (
  SELECT a.*, coalesce(r.rate, (SELECT g FROM prior)) AS rate,
         row_number() OVER (PARTITION BY a.member_id ORDER BY coalesce(r.rate, (SELECT g FROM prior)) DESC, a.channel) AS rn
  FROM (SELECT member_id,
               (CASE WHEN digital_affinity >= 70 THEN 'high' WHEN digital_affinity >= 45 THEN 'medium' ELSE 'low' END) || '|' || category AS segment,
               unnest(CASE WHEN consent_whatsapp AND has_phone THEN ['whatsapp', 'sms'] ELSE CAST([] AS VARCHAR[]) END
                      || CASE WHEN consent_email AND has_email THEN ['email'] ELSE CAST([] AS VARCHAR[]) END
                      || ['app', 'callcenter', 'branch']) AS channel
        FROM members) a
  LEFT JOIN chan_rates r ON a.segment = r.segment AND a.channel = r.channel) x WHERE rn = 1""", ["members", "chan_rates", "prior"])


@register("member_channels", "W-05, F-14, A-20", sql(f"""
SELECT member_id, segment, channel, round(rate, {DIGITS}) AS rate FROM member_channel""", "member_channel"))
def member_channels(spark, sf_dir):
    members, inter = derived.member_features(spark, sf_dir), derived.interactions(spark, sf_dir)
    out = nbo.member_channels(members, nbo.channel_rates(inter, members), nbo.global_rate(inter))
    return out.select("member_id", "segment", "channel", F.round("rate", DIGITS).alias("rate"))


# ---------------------------------------------------------------------------
# Backtest and dashboard queries
# ---------------------------------------------------------------------------

@register("backtest_hit_at_1", "A-23", sql(f"""
SELECT CAST(count(*) AS BIGINT) AS n_members,
       round(avg(CAST(list_contains(acc, primary_product) AS DOUBLE)), {DIGITS}) AS hit_at_1_engine,
       round(avg(CAST(coalesce(list_contains(acc, popular), false) AS DOUBLE)), {DIGITS}) AS hit_at_1_popularity
FROM (SELECT r.member_id, r.product_id AS primary_product, a.acc, p.popular FROM ranked r
      JOIN (SELECT member_id, list(DISTINCT product_id) AS acc FROM interactions WHERE outcome = 'accepted' GROUP BY member_id) a ON r.member_id = a.member_id
      LEFT JOIN (SELECT e.member_id, first(e.product_id ORDER BY coalesce(n.n, 0) DESC, e.product_id) AS popular
                 FROM evaluated e LEFT JOIN (SELECT product_id, count(*) AS n FROM interactions WHERE outcome = 'accepted' GROUP BY product_id) n
                   ON e.product_id = n.product_id WHERE e.ineligible_reason IS NULL GROUP BY e.member_id) p ON r.member_id = p.member_id
      WHERE r."rank" = 1) x""", "ranked", "evaluated", "interactions"))
def backtest_hit_at_1(spark, sf_dir):
    """Engine's first offer against the most accepted product among the member's eligible ones."""
    inter = derived.interactions(spark, sf_dir).filter(F.col("outcome") == "accepted")
    acc = inter.groupBy("member_id").agg(F.collect_set("product_id").alias("acc"))  # per member: at most 8 products
    counts = inter.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    popularity = counts.agg(F.map_from_entries(F.collect_list(F.struct("product_id", "n")))).scalar()  # one entry per catalog product
    ranked = _ranked(spark, sf_dir).withColumn("__n", popularity)
    eligible = F.filter("offers", lambda o: o["ineligible_reason"].isNull())
    popular = F.array_min(F.transform(eligible, lambda o: F.struct(
        (-F.coalesce(F.try_element_at(F.col("__n"), o["product_id"]), F.lit(0))).alias("order"), o["product_id"].alias("product_id"))))
    first = ranked.select("member_id", F.get("ranked", F.lit(0))["product_id"].alias("first"), popular["product_id"].alias("popular"))
    offered = F.col("first").isNotNull()  # an aggregate's condition, not a filter pushed below the rules
    hit = lambda c: F.round(F.avg(F.when(offered, F.coalesce(F.array_contains("acc", F.col(c)), F.lit(False)).cast("double"))), DIGITS)
    return first.join(acc, "member_id").agg(F.count_if(offered).alias("n_members"), hit("first").alias("hit_at_1_engine"), hit("popular").alias("hit_at_1_popularity"))


cte("lift_parts", "SELECT *, interaction_id % 10 >= 8 AS test FROM interactions", ["interactions"])


cte("lift_fit", "SELECT * FROM lift_parts WHERE NOT test", ["lift_parts"])
cte("lift_seg", """
SELECT *, (CASE WHEN digital_affinity >= 70 THEN 'high' WHEN digital_affinity >= 45 THEN 'medium' ELSE 'low' END) || '|' || category AS segment
FROM members""", ["members"])
cte("lift_g", "SELECT avg(CAST(outcome = 'accepted' AS DOUBLE)) AS g FROM lift_fit", ["lift_fit"])
cte("lift_rates", """
SELECT segment, channel, (count(*) FILTER (WHERE outcome = 'accepted') + 50 * (SELECT g FROM lift_g)) / (count(*) + 50) AS rate
FROM lift_fit f JOIN lift_seg s ON f.member_id = s.member_id GROUP BY segment, channel""", ["lift_fit", "lift_seg", "lift_g"])
cte("lift_best", """
SELECT member_id, channel FROM (
  SELECT a.member_id, a.channel, row_number() OVER (PARTITION BY a.member_id ORDER BY coalesce(r.rate, (SELECT g FROM lift_g)) DESC, a.channel) AS k
  FROM (SELECT member_id, segment, unnest(CASE WHEN consent_whatsapp AND has_phone THEN ['whatsapp', 'sms'] ELSE CAST([] AS VARCHAR[]) END
                 || CASE WHEN consent_email AND has_email THEN ['email'] ELSE CAST([] AS VARCHAR[]) END || ['app', 'callcenter', 'branch']) AS channel
        FROM lift_seg) a
  LEFT JOIN lift_rates r ON a.segment = r.segment AND a.channel = r.channel) x WHERE k = 1""", ["lift_seg", "lift_rates", "lift_g"])


@register("backtest_channel_lift", "A-24", sql(f"""
SELECT round(rec, {DIGITS}) AS accept_rate_recommended, round(maj, {DIGITS}) AS accept_rate_majority,
       round(CASE WHEN maj > 0 THEN rec / maj - 1 END, {DIGITS}) AS lift
FROM (SELECT avg(CASE WHEN i.channel = b.channel THEN CAST(i.outcome = 'accepted' AS DOUBLE) END) AS rec,
             avg(CASE WHEN i.channel = (SELECT channel FROM lift_fit GROUP BY channel ORDER BY count(*) DESC, channel LIMIT 1)
                      THEN CAST(i.outcome = 'accepted' AS DOUBLE) END) AS maj
      FROM lift_parts i JOIN lift_best b ON i.member_id = b.member_id WHERE i.test) x""", "lift_parts", "lift_fit", "lift_best"))
def backtest_channel_lift(spark, sf_dir):
    """Rates learned on four fifths of the interactions, lift measured on the rest."""
    members = derived.member_features(spark, sf_dir)
    inter = derived.interactions(spark, sf_dir)
    test = F.col("interaction_id") % 10 >= 8
    fit, held = inter.filter(~test), inter.filter(test)
    rec = nbo.member_channels(members, nbo.channel_rates(fit, members), nbo.global_rate(fit)).select("member_id", F.col("channel").alias("rec"))
    major = (fit.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("n").desc(), "channel").limit(1).select("channel").scalar())
    per = held.groupBy("member_id", "channel").agg(F.count(F.lit(1)).alias("sends"), F.count_if(F.col("outcome") == "accepted").alias("accepts"))
    rate = lambda cond: F.sum(F.when(cond, F.col("accepts"))) / F.sum(F.when(cond, F.col("sends")))
    out = per.join(rec, "member_id").withColumn("major", major).agg(
        rate(F.col("channel") == F.col("rec")).alias("r"), rate(F.col("channel") == F.col("major")).alias("m"))
    return out.select(F.round("r", DIGITS).alias("accept_rate_recommended"), F.round("m", DIGITS).alias("accept_rate_majority"),
                      F.round(F.when(F.col("m") > 0, F.col("r") / F.col("m") - 1), DIGITS).alias("lift"))


@register("backtest_coverage", "A-25", sql(f"""
SELECT CAST(count(*) AS BIGINT) AS n_members,
       CAST(count(*) FILTER (WHERE member_id IN (SELECT member_id FROM ranked)) AS BIGINT) AS n_covered,
       round(count(*) FILTER (WHERE member_id IN (SELECT member_id FROM ranked)) / CAST(count(*) AS DOUBLE), {DIGITS}) AS coverage
FROM members""", "members", "ranked"))
def backtest_coverage(spark, sf_dir):
    covered = _ranked(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_members"), F.count_if(F.size("ranked") > 0).alias("n_covered"))
    return covered.select("n_members", "n_covered", F.round(F.col("n_covered") / F.col("n_members"), DIGITS).alias("coverage"))


@register("product_distribution", "A-26, A-27", sql(f"""
SELECT product_id, CAST(count(*) AS BIGINT) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), {DIGITS}) AS share,
       round(avg(ev), {DIGITS}) AS avg_ev
FROM ranked WHERE "rank" = 1 GROUP BY product_id""", "ranked"))
def product_distribution(spark, sf_dir):
    first = _ranked(spark, sf_dir).select(F.explode(F.slice("ranked", 1, 1)).alias("o")).select("o.product_id", "o.ev")
    agg = first.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.avg("ev").alias("avg_ev"))
    total = first.agg(F.count(F.lit(1))).scalar()
    return agg.select("product_id", "n", F.round(F.col("n") / total, DIGITS).alias("share"), F.round("avg_ev", DIGITS).alias("avg_ev"))


@register("offer_funnel", "A-33", sql("""
SELECT CAST(count(*) AS BIGINT) AS candidate_pairs,
       CAST(count(*) FILTER (WHERE ineligible_reason IS NULL) AS BIGINT) AS eligible,
       CAST(count(*) FILTER (WHERE ev IS NOT NULL) AS BIGINT) AS scored,
       CAST(count(*) FILTER (WHERE ev > 0) AS BIGINT) AS positive_ev,
       CAST((SELECT count(*) FROM ranked) AS BIGINT) AS ranked,
       CAST((SELECT count(*) FROM ranked WHERE "rank" = 1) AS BIGINT) AS primary_offers
FROM evaluated""", "evaluated", "ranked"))
def offer_funnel(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    count = lambda cond: F.size(F.filter("offers", cond))
    parts = {"candidate_pairs": F.size("offers"), "eligible": count(lambda o: o["ineligible_reason"].isNull()), "scored": count(lambda o: o["ev"].isNotNull()),
             "positive_ev": count(lambda o: o["ev"] > 0), "ranked": F.size("ranked"), "primary_offers": (F.size("ranked") > 0).cast("int")}
    return r.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in parts.items()])


PRODUCTS = [p[0] for p in fixed.PRODUCT_CATALOG]
cte("monthly", f"""SELECT {pick('o_orderkey', 8, PRODUCTS)} AS product_id, month(o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1, 2""")
cte("season", """
SELECT product_id, first(month ORDER BY n DESC, month) AS top_month, max(n) AS top_n,
       coalesce(sum(n) FILTER (WHERE month = (SELECT month(max(o_orderdate)) FROM orders)), 0) AS current_n
FROM monthly GROUP BY product_id""", ["monthly"])


def _seasonal(spark, sf_dir):
    """All orders by product and month."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    current = o.agg(F.month(F.max("o_orderdate"))).scalar()
    monthly = o.select(derived._pick(F.col("o_orderkey"), 8, PRODUCTS).alias("product_id"), F.month("o_orderdate").alias("month")).groupBy("product_id", "month").agg(F.count(F.lit(1)).alias("n"))
    return nbo.seasonal_products(monthly, current)


@register("seasonality", "A-22", sql(f"""
SELECT product_id, CAST(top_month AS INTEGER) AS top_month, CAST(top_n AS BIGINT) AS top_n, CAST(current_n AS BIGINT) AS current_n,
       round(CASE WHEN current_n > 0 THEN top_n / CAST(current_n AS DOUBLE) END, {DIGITS}) AS ratio, top_n >= 1.3 * current_n AS applies
FROM season""", "season"))
def seasonality(spark, sf_dir):
    """Per product: busiest month of the year vs the current month; applies at >= 1.3x."""
    return _seasonal(spark, sf_dir).withColumn("ratio", F.round("ratio", DIGITS))


cte("chan_windows", """
SELECT segment, channel, first(contact_window ORDER BY rate DESC, contact_window) AS contact_window FROM (
  SELECT segment, channel, contact_window, (count(*) FILTER (WHERE outcome = 'accepted') + 50 * (SELECT g FROM prior)) / (count(*) + 50) AS rate
  FROM segmented GROUP BY segment, channel, contact_window) a GROUP BY segment, channel""", ["segmented", "prior"])


cte("responses", """
SELECT d.member_id, d.risk_tier, d.primary_product, d.alternatives, o.amount, o.instalment, mc.channel, w.contact_window,
       CASE WHEN d.primary_product IS NULL THEN NULL
            WHEN m.months_since_event <= 12 THEN 'life_event' WHEN m.tenure_months <= 3 THEN 'new_member'
            WHEN m.months_since_last_credit <= 3 AND m.active_credit = 0 THEN 'cleared_credit'
            WHEN s.top_n >= 1.3 * s.current_n THEN 'seasonality' ELSE 'inmediato' END AS timing
FROM decided d JOIN gap_members m ON d.member_id = m.member_id
LEFT JOIN (SELECT member_id, CAST(round(amount) AS BIGINT) AS amount, CAST(round(instalment) AS BIGINT) AS instalment FROM ranked WHERE "rank" = 1) o ON d.member_id = o.member_id
LEFT JOIN season s ON s.product_id = d.primary_product
JOIN gap_channel mc ON mc.member_id = d.member_id
LEFT JOIN chan_windows w ON w.segment = mc.segment AND w.channel = mc.channel""", ["decided", "gap_members", "ranked", "season", "gap_channel", "chan_windows"])


@register("nbo_response", "P-03, F-17, W-05, F-14", sql("SELECT * FROM responses", "responses"))
def nbo_response(spark, sf_dir):
    """Whole decision, one row per member: offer, alternatives, channel, window, timing."""
    ranked = _ranked(spark, sf_dir)
    members, inter = derived.member_features(spark, sf_dir), derived.interactions(spark, sf_dir)
    rates, windows = nbo.channel_rates(inter, members), nbo.best_windows(inter, members)
    full = nbo.member_channels(ranked, rates, nbo.global_rate(inter), windows)
    season = _seasonal(spark, sf_dir)
    in_season = season.agg(F.map_from_entries(F.collect_list(F.struct("product_id", "applies")))).scalar()  # one entry per catalog product
    first = F.get("ranked", F.lit(0))
    full = full.withColumns({"__o": first, "__season": in_season})
    full = full.withColumn("in_season", F.try_element_at(F.col("__season"), F.col("__o.product_id")))
    return full.select(
        "member_id", "risk_tier", F.col("__o.product_id").alias("primary_product"), F.transform(F.slice("ranked", 2, 100), lambda o: o["product_id"]).alias("alternatives"),
        F.round("__o.amount").cast("bigint").alias("amount"), F.round("__o.instalment").cast("bigint").alias("instalment"), "channel", "contact_window",
        F.when(F.col("__o").isNotNull(), nbo.timing()).alias("timing"))


cte("gap_channel", """
SELECT member_id, segment, channel FROM (
  SELECT a.*, row_number() OVER (PARTITION BY a.member_id ORDER BY coalesce(r.rate, (SELECT g FROM prior)) DESC, a.channel) AS rn
  FROM (SELECT member_id,
               concat_ws('|', CASE WHEN digital_affinity >= 70 THEN 'high' WHEN digital_affinity >= 45 THEN 'medium' ELSE 'low' END, category) AS segment,
               unnest(CASE WHEN consent_whatsapp AND has_phone THEN ['whatsapp', 'sms'] ELSE CAST([] AS VARCHAR[]) END
                      || CASE WHEN consent_email AND has_email THEN ['email'] ELSE CAST([] AS VARCHAR[]) END
                      || ['app', 'callcenter', 'branch']) AS channel
        FROM gap_members) a
  LEFT JOIN chan_rates r ON a.segment = r.segment AND a.channel = r.channel) x WHERE rn = 1""", ["gap_members", "chan_rates", "prior"])


@register("decision_reasons", "P-03", sql("""
SELECT member_id, primary_product, 'Te recomendamos ' || replace(primary_product, '_', ' ')
  || '; la cuota mensual de $' || replace(format('{:,}', CAST(round_even(instalment / 1000.0, 0) AS BIGINT) * 1000), ',', '.') || ' no supera el 30% de tu ingreso disponible; te contactamos por '
  || CASE channel WHEN 'whatsapp' THEN 'WhatsApp' WHEN 'sms' THEN 'SMS' WHEN 'email' THEN 'correo' WHEN 'app' THEN 'la app' WHEN 'callcenter' THEN 'llamada' ELSE 'la oficina' END
  || CASE contact_window WHEN 'morning' THEN ' en la mañana' WHEN 'midday' THEN ' al mediodía' WHEN 'afternoon' THEN ' en la tarde' WHEN 'night' THEN ' en la noche' ELSE '' END
  || CASE timing WHEN 'life_event' THEN ', por tu evento de vida reciente' WHEN 'new_member' THEN ', por tu ingreso a la caja' WHEN 'cleared_credit' THEN ', por tu crédito ya pagado'
                 WHEN 'seasonality' THEN ', por la temporada' ELSE ', de inmediato' END || '.' AS reason
FROM responses""", "responses"))
def decision_reasons(spark, sf_dir):
    """Every member's decision with its reason sentence (null without an offer)."""
    return reasons.with_reasons(nbo_response(spark, sf_dir)).select("member_id", "primary_product", "reason")


@register("wage_tiers", "F-32", sql(f"""
SELECT member_id, CASE WHEN v IS NOT NULL THEN round(least(greatest(v / {fixed.SMMLV_COP}, 1.0), 25.0), 10) END AS wages, CASE WHEN v <= 2 * {fixed.SMMLV_COP} THEN 'A' WHEN v <= 4 * {fixed.SMMLV_COP} THEN 'B' WHEN v IS NOT NULL THEN 'C' END AS tier
FROM (SELECT member_id, CASE WHEN NOT isnan(income) THEN CAST(income AS DOUBLE) END AS v FROM gap_members) m""", "gap_members"))
def wage_tiers(spark, sf_dir):
    """Every member's income in minimum wages and its tier; a missing income has neither."""
    income = F.col("income")
    return derived.decision_members(spark, sf_dir).select("member_id", F.round(money.income_in_wages(income), 10).alias("wages"), money.wage_tier(income).alias("tier"))
