"""Model queries: WoE table (SQL-checked) and trained-model outputs (rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.operators import calibration, metrics, models, quality, reasons, tree_attribution
from cauce.plans.oracle import cte, sql
from cauce.plans.registry import register
from cauce.sources import derived
from cauce.sources.tables import read_table

DIGITS = 10
WOE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
MODEL_FEATURES = ["age", "income", "job_tenure_months", "internal_score", "debt_ratio", "digital_affinity",
                  "dependents", "n_orders", "months_since_event"]


def _credit_lines(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *WOE_FEATURES)
    return li.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


cte("woe_long", "SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, "
                "unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem")
cte("woe_edges", """
SELECT feature, edge FROM (
  SELECT feature, edge, min(edge) OVER (PARTITION BY feature) AS lo, max(edge) OVER (PARTITION BY feature) AS hi
  FROM (SELECT DISTINCT feature, unnest(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edge
        FROM woe_long GROUP BY feature) e) x
WHERE edge > lo AND edge < hi""", ["woe_long"])


@register("woe_table", "A-18, M-04", sql(f"""
SELECT feature, CAST(bin AS BIGINT) AS bin, min_value, max_value, CAST(n AS BIGINT) AS n, CAST(bad AS BIGINT) AS bad,
       CAST(good AS BIGINT) AS good, round(woe, {DIGITS}) AS woe, round((bad / B - good / G) * woe, {DIGITS}) AS iv_part
FROM (SELECT *, ln(((bad + 0.5) / B) / ((good + 0.5) / G)) AS woe FROM (
  SELECT b.*, sum(bad) OVER (PARTITION BY feature) AS B, sum(good) OVER (PARTITION BY feature) AS G FROM (
    SELECT feature, bin, min(value) AS min_value, max(value) AS max_value, sum(n) AS n, sum(bad) AS bad, sum(n) - sum(bad) AS good
    FROM (SELECT d.*, (SELECT count(*) FROM woe_edges e WHERE e.feature = d.feature AND d.value > e.edge) AS bin
          FROM (SELECT feature, value, count(*) AS n, sum(y) AS bad FROM woe_long GROUP BY feature, value) d) x
    GROUP BY feature, bin) b) c) w""", "woe_long", "woe_edges"))
def woe_table(spark, sf_dir):
    t = models.woe_table(_credit_lines(spark, sf_dir), "y", WOE_FEATURES)
    return t.withColumn("woe", F.round("woe", DIGITS)).withColumn("iv_part", F.round("iv_part", DIGITS))


def _model_frame(spark, sf_dir):
    m = derived.member_features(spark, sf_dir)
    # label: a member whose pending orders exceed a third of all orders
    m = m.withColumn("default_12m", ((F.col("n_pending") * 3) > F.col("n_orders")).cast("int"))
    m = m.withColumn("__key", F.col("member_id").cast("bigint"))
    return quality.stratified_split(m, "__key", "default_12m")


@register("model_default_scores", "M-01, M-02, M-05, M-06, M-08, M-09")
def model_default_scores(spark, sf_dir):
    """GBT on train, isotonic on valid, calibrated scores for every member (rows-only check)."""
    frame = _model_frame(spark, sf_dir)
    gbt = models.train_gbt(frame.filter(F.col("split") == "train"), "default_12m", MODEL_FEATURES, max_iter=20)
    scored = models.score_gbt(gbt, frame, MODEL_FEATURES)
    iso = models.fit_isotonic(scored.filter(F.col("split") == "valid"), "default_12m")
    cal = models.apply_isotonic(iso, scored)
    return cal.select("member_id", "split", "default_12m", F.lit("default_12m").alias("model"),
                      F.col("raw_score").alias("raw"), "calibrated")


@register("model_calibration_report", "A-15, A-16")
def model_calibration_report(spark, sf_dir):
    """Raw vs calibrated Brier/ECE and AUC on the test split (rows-only check)."""
    s = model_default_scores(spark, sf_dir).filter(F.col("split") == "test")
    raw = metrics.ranking_summary(s.select(F.col("default_12m").alias("y"), F.col("raw").alias("p")))
    ece_raw = metrics.ece(s.select(F.col("default_12m").alias("y"), F.col("raw").alias("p"))).select(F.col("ece").alias("raw_ece"))
    ece_cal = metrics.ece(s.select(F.col("default_12m").alias("y"), F.col("calibrated").alias("p"))).select(F.col("ece").alias("calibrated_ece"))
    r = raw.select("n", "test_auc", "test_ks", "test_gini", "brier_score", "prevalence")
    return r.select("*", ece_raw.select("raw_ece").scalar().alias("raw_ece"),
                    ece_cal.select("calibrated_ece").scalar().alias("calibrated_ece"))


def _scorecard(spark, sf_dir):
    frame = _model_frame(spark, sf_dir)
    train = frame.filter(F.col("split") == "train")
    woe = models.apply_woe(frame, train, "default_12m", MODEL_FEATURES, "member_id")
    woe = woe.join(frame.select("member_id", "default_12m", "split"), "member_id")
    lr = models.train_scorecard(woe.filter(F.col("split") == "train"), "default_12m", MODEL_FEATURES)
    return woe, lr


@register("scorecard_drivers", "M-03, M-11, W-03")
def scorecard_drivers(spark, sf_dir):
    """Top-3 positive scorecard attributions per member (rows-only check)."""
    woe, lr = _scorecard(spark, sf_dir)
    phi = models.scorecard_attributions(woe.fillna(0.0, subset=MODEL_FEATURES), lr, MODEL_FEATURES, "member_id")
    return models.top_positive_drivers(phi, "member_id")


@register("attribution_importance", "A-19, W-11, M-12")
def attribution_importance(spark, sf_dir):
    """Mean |phi| per feature, descending (rows-only check)."""
    woe, lr = _scorecard(spark, sf_dir)
    phi = models.scorecard_attributions(woe.fillna(0.0, subset=MODEL_FEATURES), lr, MODEL_FEATURES, "member_id")
    return models.global_importance(phi)


cte("product_scores", """
SELECT m.member_id, c.product_id, CAST((m.k * (2 * c.idx + 3) + 17 * c.idx) % 50 AS DOUBLE) / 100 AS raw, a.y
FROM gap_members m CROSS JOIN catalog c
LEFT JOIN (SELECT member_id, product_id, max(CAST(outcome = 'accepted' AS INTEGER)) AS y FROM interactions GROUP BY member_id, product_id) a
  ON a.member_id = m.member_id AND a.product_id = c.product_id""", ["gap_members", "catalog", "interactions"])
cte("score_points", "SELECT product_id, raw, CAST(count(*) AS DOUBLE) AS w, CAST(sum(y) AS DOUBLE) AS pos FROM product_scores WHERE y IS NOT NULL GROUP BY product_id, raw", ["product_scores"])
cte("score_runs", """
SELECT a.product_id, a.raw AS low, b.raw AS high, sum(c.pos) / sum(c.w) AS mean
FROM score_points a JOIN score_points b ON a.product_id = b.product_id AND a.raw <= b.raw JOIN score_points c ON c.product_id = a.product_id AND c.raw BETWEEN a.raw AND b.raw
GROUP BY a.product_id, a.raw, b.raw""", ["score_points"])
# the isotonic fit at a point: the largest, over runs that begin there or before, of the least mean among runs that end there or after
cte("score_fit", """
SELECT product_id, raw, max(least_mean) AS fit FROM (
  SELECT p.product_id, p.raw, r.low, min(r.mean) AS least_mean FROM score_points p JOIN score_runs r ON r.product_id = p.product_id AND r.low <= p.raw AND r.high >= p.raw
  GROUP BY p.product_id, p.raw, r.low) x GROUP BY product_id, raw""", ["score_points", "score_runs"])


@register("calibrated_scores", "J-07, M-05, M-06, M-08", sql(f"""
SELECT s.member_id, s.product_id, s.raw, round(CASE WHEN f.lo IS NULL AND f.hi IS NULL THEN s.raw WHEN f.lo IS NULL THEN f.hi_fit WHEN f.hi IS NULL OR f.lo = s.raw THEN f.lo_fit
       ELSE f.lo_fit + (f.hi_fit - f.lo_fit) * (s.raw - f.lo) / (f.hi - f.lo) END, {DIGITS}) + 0.0 AS calibrated
FROM product_scores s LEFT JOIN (
  SELECT d.product_id, d.raw, max(b.raw) FILTER (WHERE b.raw <= d.raw) AS lo, max_by(b.fit, b.raw) FILTER (WHERE b.raw <= d.raw) AS lo_fit,
         min(b.raw) FILTER (WHERE b.raw > d.raw) AS hi, min_by(b.fit, b.raw) FILTER (WHERE b.raw > d.raw) AS hi_fit
  FROM (SELECT DISTINCT product_id, raw FROM product_scores) d LEFT JOIN score_fit b ON b.product_id = d.product_id GROUP BY d.product_id, d.raw) f
  ON f.product_id = s.product_id AND f.raw = s.raw""", "product_scores", "score_fit"))
def calibrated_scores(spark, sf_dir):
    """Every member's score for every product through that product's isotonic calibrator."""
    scores = derived.product_scores(spark, sf_dir)
    held = calibration.fit_calibrators(scores.where("y is not null"))
    out = calibration.apply_calibrators(scores.drop("y"), held)
    return out.withColumn("calibrated", F.round("calibrated", DIGITS))


def _tree_phi(spark, sf_dir):
    frame = _model_frame(spark, sf_dir)
    gbt = models.train_gbt(frame.filter(F.col("split") == "train"), "default_12m", MODEL_FEATURES, max_iter=20)
    return tree_attribution.attributions(frame, gbt, MODEL_FEATURES, "member_id")


@register("tree_drivers", "M-11, W-03")
def tree_drivers(spark, sf_dir):
    """Top-3 positive exact attributions of the boosted trees per member, with the features' values (rows-only check)."""
    return models.top_positive_drivers(_tree_phi(spark, sf_dir), "member_id")


@register("tree_importance", "A-19, W-11")
def tree_importance(spark, sf_dir):
    """Mean |phi| per feature of the boosted trees, descending (rows-only check)."""
    return models.global_importance(_tree_phi(spark, sf_dir))


@register("driver_reasons", "F-37, W-03")
def driver_reasons(spark, sf_dir):
    """The top-3 positive drivers of every member as one phrase, null without any (rows-only check)."""
    top = models.top_positive_drivers(_tree_phi(spark, sf_dir), "member_id")
    return top.select("member_id", reasons.driver_reason(F.col("drivers")).alias("reason"))
