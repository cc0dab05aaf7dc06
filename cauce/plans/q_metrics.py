"""Model-quality metric queries over ``scored`` (bound to ``lineitem``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.operators import metrics
from cauce.plans.oracle import cte, sql
from cauce.plans.registry import register
from cauce.sources import derived

DIGITS = 10

cte("scored", """
SELECT l_orderkey * 10 + l_linenumber AS score_id,
       CAST(l_returnflag = 'R' AS INTEGER) AS y,
       ((CAST(l_quantity AS BIGINT) * 7 + CAST(round(l_discount * 100) AS BIGINT) * 13) % 101) / CAST(101 AS DOUBLE) AS p,
       l_linestatus AS grp,
       l_tax >= 0.04 AS tax_high
FROM lineitem""")

cte("roc", """
SELECT p, n, n_pos, n_neg, cum_pos, cum_neg, cum_pos / CAST(tot_pos AS DOUBLE) AS tpr, cum_neg / CAST(tot_neg AS DOUBLE) AS fpr,
       tot_pos, tot_neg
FROM (SELECT *, sum(n_pos) OVER (ORDER BY p) AS cum_pos, sum(n_neg) OVER (ORDER BY p) AS cum_neg,
             sum(n_pos) OVER () AS tot_pos, sum(n_neg) OVER () AS tot_neg
      FROM (SELECT p, count(*) AS n, sum(y) AS n_pos, sum(1 - y) AS n_neg FROM scored GROUP BY p) d) c""", ["scored"])


def _round(df, cols):
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), DIGITS))
    return df


@register("metric_summary", "A-07, A-08, A-09, A-10, A-14, A-15, W-04", sql(f"""
SELECT CAST(n AS BIGINT) AS n, CAST(tp AS BIGINT) AS n_pos,
       round(auc, {DIGITS}) AS test_auc, round(CASE WHEN tp = 0 OR tn = 0 THEN 0.0 ELSE ks END, {DIGITS}) AS test_ks,
       round(2.0 * auc - 1.0, {DIGITS}) AS test_gini, round(brier, {DIGITS}) AS brier_score,
       round(prevalence, {DIGITS}) AS prevalence, round(auc / 0.62, {DIGITS}) AS signal_recovery_pct
FROM (SELECT CAST(sum(n_pos * (2 * (cum_neg - n_neg) + n_neg)) AS DOUBLE) / (2.0 * CAST(max(tot_pos) AS DOUBLE) * CAST(max(tot_neg) AS DOUBLE)) AS auc,
             max(abs(tpr - fpr)) AS ks, max(tot_pos) AS tp, max(tot_neg) AS tn FROM roc) r,
     (SELECT count(*) AS n, avg(pow(p - y, 2)) AS brier, avg(CAST(y AS DOUBLE)) AS prevalence FROM scored) s""", "roc", "scored"))
def metric_summary(spark, sf_dir):
    out = metrics.ranking_summary(derived.scored(spark, sf_dir), ceiling=0.62)
    return _round(out, ["test_auc", "test_ks", "test_gini", "brier_score", "prevalence", "signal_recovery_pct"])


@register("ks_curve", "W-04, A-08", sql(f"""
SELECT p, CAST(n AS BIGINT) AS n, CAST(cum_pos AS BIGINT) AS cum_pos, CAST(cum_neg AS BIGINT) AS cum_neg,
       round(tpr, {DIGITS}) AS tpr, round(fpr, {DIGITS}) AS fpr FROM roc""", "roc"))
def ks_curve(spark, sf_dir):
    pts = metrics.roc_points(derived.scored(spark, sf_dir))
    return _round(pts.select("p", "n", "cum_pos", "cum_neg", "tpr", "fpr"), ["tpr", "fpr"])


@register("metric_ece", "A-11", sql(f"""
SELECT round(sum(n_b * abs(acc - conf)) / sum(n_b), {DIGITS}) AS ece, CAST(count(*) AS BIGINT) AS n_bins_used
FROM (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n_b, avg(CAST(y AS DOUBLE)) AS acc, avg(p) AS conf
      FROM scored GROUP BY 1) b""", "scored"))
def metric_ece(spark, sf_dir):
    return _round(metrics.ece(derived.scored(spark, sf_dir)), ["ece"])


@register("metric_reliability", "A-11", sql(f"""
SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS "count",
       round(avg(CAST(y AS DOUBLE)), {DIGITS}) AS accuracy, round(avg(p), {DIGITS}) AS confidence
FROM scored GROUP BY 1""", "scored"))
def metric_reliability(spark, sf_dir):
    return _round(metrics.ece_bins(derived.scored(spark, sf_dir)), ["accuracy", "confidence"])


@register("metric_lift", "A-12", sql(f"""
SELECT decile, CAST(sum(n) AS BIGINT) AS "count", round(sum(n_pos) / CAST(sum(n) AS DOUBLE), {DIGITS}) AS positive_rate,
       round(CASE WHEN max(overall) > 0 THEN (sum(n_pos) / CAST(sum(n) AS DOUBLE)) / max(overall) ELSE 0.0 END, {DIGITS}) AS lift
FROM (SELECT d.*, (SELECT CAST(count(*) AS INTEGER) FROM inner_edges e WHERE d.p > e.edge) AS decile,
             (SELECT sum(y) / CAST(count(*) AS DOUBLE) FROM scored) AS overall
      FROM (SELECT p, count(*) AS n, sum(y) AS n_pos FROM scored GROUP BY p) d) x
GROUP BY decile""", "inner_edges"))
def metric_lift(spark, sf_dir):
    return _round(metrics.lift_table(derived.scored(spark, sf_dir)), ["positive_rate", "lift"])


cte("edges", """
SELECT DISTINCT unnest(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edge FROM scored""", ["scored"])
cte("inner_edges", """
SELECT edge FROM edges WHERE edge > (SELECT min(edge) FROM edges) AND edge < (SELECT max(edge) FROM edges)""", ["edges"])


@register("metric_quantile_edges", "A-12", sql(f"""
SELECT unnest(CAST([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0] AS DOUBLE[])) AS q,
       round(unnest(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])), {DIGITS}) AS edge
FROM scored""", "scored"))
def metric_quantile_edges(spark, sf_dir):
    probs = [i / 10 for i in range(11)]
    s = derived.scored(spark, sf_dir)
    return _round(metrics.quantile_edges(s, "p", probs), ["edge"])


@register("metric_fairness", "A-13, W-06, J-09, T-02", sql(f"""
SELECT group_name, CAST(group_size AS BIGINT) AS group_size, CAST(group_selected AS BIGINT) AS group_selected,
       round(g_rate, {DIGITS}) AS group_selection_rate, round(o_rate, {DIGITS}) AS overall_selection_rate,
       round(ratio, {DIGITS}) AS disparate_impact_ratio, ratio >= 0.8 AS passes_four_fifths_rule,
       round(group_selected / CAST(group_size AS DOUBLE), {DIGITS}) AS selection_share,
       round(CASE WHEN sel / CAST(n AS DOUBLE) > 0 THEN (group_selected / CAST(group_size AS DOUBLE)) / (sel / CAST(n AS DOUBLE)) ELSE 1.0 END, {DIGITS}) AS selection_share_ratio
FROM (SELECT *, CASE WHEN o_rate > 0 THEN g_rate / o_rate ELSE 1.0 END AS ratio
      FROM (SELECT g.group_name, count(*) AS group_size, count(*) FILTER (WHERE in_top) AS group_selected,
                   CASE WHEN count(*) FILTER (WHERE in_top) > 0
                        THEN sum(CASE WHEN in_top THEN y ELSE 0 END) / CAST(count(*) FILTER (WHERE in_top) AS DOUBLE) ELSE 0.0 END AS g_rate,
                   max(o.o_rate) AS o_rate, max(o.sel) AS sel, max(o.n) AS n
            FROM (SELECT 'linestatus_O' AS group_name, * FROM flagged WHERE grp = 'O'
                  UNION ALL SELECT 'linestatus_F', * FROM flagged WHERE grp = 'F'
                  UNION ALL SELECT 'tax_high', * FROM flagged WHERE tax_high) g,
                 (SELECT count(*) AS n, count(*) FILTER (WHERE in_top) AS sel,
                         CASE WHEN count(*) FILTER (WHERE in_top) > 0
                              THEN sum(CASE WHEN in_top THEN y ELSE 0 END) / CAST(count(*) FILTER (WHERE in_top) AS DOUBLE) ELSE 0.0 END AS o_rate
                  FROM flagged) o
            GROUP BY g.group_name) a) b""", "flagged"))
def metric_fairness(spark, sf_dir):
    groups = {"linestatus_O": "grp = 'O'", "linestatus_F": "grp = 'F'", "tax_high": "tax_high"}
    out = metrics.fairness_audit(derived.scored(spark, sf_dir), groups, id_col="score_id")
    return _round(out, ["group_selection_rate", "overall_selection_rate", "disparate_impact_ratio",
                        "selection_share", "selection_share_ratio"])


cte("flagged", """
SELECT *, row_number() OVER (ORDER BY p DESC, score_id) <= (SELECT CAST(floor(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM scored) AS in_top
FROM scored""", ["scored"])


@register("score_summary", "A-17", sql(f"""
SELECT grp, min(p) AS min_score, max(p) AS max_score, round(avg(p), {DIGITS}) AS mean_score, CAST(count(*) AS BIGINT) AS n
FROM scored GROUP BY grp""", "scored"))
def score_summary(spark, sf_dir):
    return _round(metrics.score_summary(derived.scored(spark, sf_dir), "grp"), ["mean_score"])
