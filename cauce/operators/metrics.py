"""Model-quality metrics over a scored table (id, y in {0,1}, score p).

Every metric starts from the distinct-score distribution (a partial
aggregate: one row per distinct score per map task), so ties are handled
exactly (KS and AUC are tie-aware) and the large table is read once. The
running totals that KS, AUC and the quantile edges need are computed by
``cumulative_sums`` (range partitions + per-partition offsets), never by a
single-task global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cauce import fixed
from cauce.operators.ordering import cumulative_sums, global_row_number


def score_distribution(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(p, n, n_pos, n_neg) per distinct score."""
    return scored.groupBy(F.col(p).alias("p")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col(y).cast("bigint")).alias("n_pos"),
        F.sum((1 - F.col(y)).cast("bigint")).alias("n_neg"),
    )


def roc_points(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Cumulative counts per distinct score in ascending order, with TPR/FPR.

    Columns: p, n, n_pos, n_neg, cum_pos, cum_neg, tpr, fpr (cumulative up
    to and including p).
    """
    dist = score_distribution(scored, y, p)
    cum = cumulative_sums(dist, "p", ["n_pos", "n_neg"])
    tot = dist.agg(F.struct(F.sum("n_pos").alias("a"), F.sum("n_neg").alias("b"))).scalar()
    out = cum.withColumn("tot_pos", tot["a"]).withColumn("tot_neg", tot["b"])
    return out.select(
        "p", "n", "n_pos", "n_neg",
        F.col("n_pos_cum").alias("cum_pos"), F.col("n_neg_cum").alias("cum_neg"),
        F.try_divide(F.col("n_pos_cum"), F.col("tot_pos")).alias("tpr"),
        F.try_divide(F.col("n_neg_cum"), F.col("tot_neg")).alias("fpr"),
        "tot_pos", "tot_neg",
    )


def ranking_summary(scored: DataFrame, y: str = "y", p: str = "p", ceiling: float | None = None) -> DataFrame:
    """One row: n, n_pos, AUC, KS, Gini, Brier, prevalence, signal recovery.

    AUC = sum over scores of n_pos * (2 * negatives_below + n_neg) / (2 P N),
    the tie-aware rank-sum form, accumulated in integers. KS = max |TPR-FPR|
    over distinct scores; 0 when one class is empty.
    """
    pts = roc_points(scored, y, p)
    ranks = pts.agg(
        F.sum(F.col("n_pos") * (2 * (F.col("cum_neg") - F.col("n_neg")) + F.col("n_neg"))).alias("auc_num"),
        F.max(F.abs(F.col("tpr") - F.col("fpr"))).alias("ks_raw"),
        F.first("tot_pos").alias("tot_pos"), F.first("tot_neg").alias("tot_neg"),
    )
    point = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier_score"),
        F.avg(F.col(y).cast("double")).alias("prevalence"),
    )
    pt = point.select(F.struct(*point.columns)).scalar()  # one-row aggregate as a scalar subquery
    both = ranks.select("*", *[pt[c].alias(c) for c in point.columns])
    auc = F.try_divide(F.col("auc_num").cast("double"), 2.0 * F.col("tot_pos") * F.col("tot_neg"))
    out = both.select(
        "n", F.col("tot_pos").alias("n_pos"),
        auc.alias("test_auc"),
        F.when((F.col("tot_pos") == 0) | (F.col("tot_neg") == 0), F.lit(0.0)).otherwise(F.col("ks_raw")).alias("test_ks"),
        (2.0 * auc - 1.0).alias("test_gini"),
        "brier_score", "prevalence",
    )
    if ceiling is not None:
        out = out.withColumn("signal_recovery_pct", F.col("test_auc") / ceiling if ceiling > 0 else F.lit(0.0))
    return out


def ece(scored: DataFrame, y: str = "y", p: str = "p", n_bins: int = fixed.ECE_BINS) -> DataFrame:
    """Expected calibration error: 10 equal bins, last one closed, empty bins skipped."""
    b = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    bins = scored.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n_b"), F.avg(F.col(y).cast("double")).alias("acc"), F.avg(F.col(p)).alias("conf"))
    return bins.agg(
        (F.sum(F.col("n_b") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n_b")).alias("ece"),
        F.count(F.lit(1)).alias("n_bins_used"),
    )


def ece_bins(scored: DataFrame, y: str = "y", p: str = "p", n_bins: int = fixed.ECE_BINS) -> DataFrame:
    """Reliability table per non-empty bin: count, accuracy, confidence."""
    b = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col(y).cast("double")).alias("accuracy"),
        F.avg(F.col(p)).alias("confidence"))


def quantile_edges(values: DataFrame, value: str, probs: list[float], group: list[str] | None = None,
                   count: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy/DuckDB ``quantile_cont``).

    ``values`` may carry a multiplicity column ``count``. The value at rank r
    is found from running counts over distinct (group, value) pairs; the
    target ranks (two per probability) form a small frame per group that is
    range-joined to the running counts (broadcast: its size is groups x
    probabilities). Output: group..., q, edge.
    """
    group = group or []
    cnt = F.col(count) if count else F.lit(1)
    dist = values.groupBy(*group, F.col(value).alias("__v")).agg(F.sum(cnt).cast("bigint").alias("__n"))
    cum = cumulative_sums(dist, [*group, "__v"], ["__n"])
    starts = dist.groupBy(*group).agg(F.sum("__n").alias("__tot"))
    if group:
        first = cum.groupBy(*group).agg(F.min(F.col("__n_cum") - F.col("__n")).alias("__start"))
        cum = cum.join(first, group)
    else:
        cum = cum.withColumn("__start", F.lit(0))
    cum = cum.select(*group, "__v", (F.col("__n_cum") - F.col("__n") - F.col("__start")).alias("lo_rank"),
                     (F.col("__n_cum") - F.col("__start")).alias("hi_rank"))
    pos = F.col("q") * (F.col("__tot") - 1)
    targets = (starts.select(*group, "__tot", F.explode(F.array(*[F.lit(q) for q in probs])).alias("q"))
               .select(*group, "q", "__tot", F.floor(pos).cast("bigint").alias("r0"), (pos - F.floor(pos)).alias("frac"))
               .withColumn("r1", F.least(F.col("r0") + 1, F.col("__tot") - 1)))

    def value_at(rank: str, alias: str) -> DataFrame:
        cond = [F.col(f"t.{rank}") >= F.col("c.lo_rank"), F.col(f"t.{rank}") < F.col("c.hi_rank")]
        cond += [F.col(f"t.{g}") == F.col(f"c.{g}") for g in group]
        j = F.broadcast(targets.alias("t")).join(cum.alias("c"), cond)
        return j.select(*[F.col(f"t.{g}") for g in group], F.col("t.q"), F.col("t.frac"), F.col("c.__v").alias(alias))

    e = value_at("r0", "__lo").join(value_at("r1", "__hi").drop("frac"), [*group, "q"])
    return e.select(*group, "q", (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("frac")).alias("edge"))


def lift_table(scored: DataFrame, y: str = "y", p: str = "p", n_deciles: int = fixed.LIFT_DECILES) -> DataFrame:
    """Decile lift: quantile edges, duplicate edges dropped, right-closed bins.

    decile 0 holds the lowest scores. The distinct edges are at most
    ``n_deciles + 1`` numbers, so they are brought to the driver and turned
    into a bucketing expression; the rows themselves never leave Spark.
    """
    probs = [i / n_deciles for i in range(n_deciles + 1)]
    dist = score_distribution(scored, y, p)
    edges = sorted({r["edge"] for r in quantile_edges(dist, "p", probs, count="n").collect()})
    inner = edges[1:-1]
    bucket = F.lit(0)
    for e in inner:
        bucket = bucket + F.when(F.col("p") > F.lit(e), 1).otherwise(0)
    per = dist.groupBy(bucket.alias("decile")).agg(
        F.sum("n").alias("count"), F.sum("n_pos").alias("__pos"))
    out = per.withColumn("__overall", dist.agg(F.sum("n_pos") / F.sum("n")).scalar())
    return out.select(
        "decile", "count",
        (F.col("__pos") / F.col("count")).alias("positive_rate"),
        F.when(F.col("__overall") > 0, (F.col("__pos") / F.col("count")) / F.col("__overall")).otherwise(F.lit(0.0)).alias("lift"),
    )


def top_k_flags(scored: DataFrame, top_k_pct: float, id_col: str, p: str = "p") -> DataFrame:
    """Adds ``in_top``: the first ``int(n * pct)`` rows by score desc, id asc (unique; null scores last, null ids first).

    The cut score comes from the distinct scores and their counts; only the ids
    of the rows that tie there are ranked. The rows themselves are flagged where
    they are, without a shuffle. The driver holds the cut score and the cut id.
    """
    cum = cumulative_sums(scored.groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n")), "p", ["n"])
    n = cum.agg(F.sum("n")).first()[0] or 0
    n_top = int(n * top_k_pct)
    above = n - F.col("n_cum")
    cut = cum.filter((above < n_top) & (F.col("n") + above >= n_top)).select("p", "n", (n_top - above).alias("k")).first()
    if cut is None:  # nobody is selected
        return scored.withColumn("in_top", F.lit(False))
    tied, score, key = F.col(p).eqNullSafe(F.lit(cut["p"])), F.col(p), F.col(id_col)
    first = F.lit(True)
    if cut["k"] < cut["n"]:
        last = global_row_number(scored.filter(tied).select(id_col), [key], out="__rank").filter(F.col("__rank") == cut["k"]).first()[id_col]
        first = key.isNull() | F.coalesce(key <= F.lit(last), F.lit(False))
    higher = score.isNotNull() if cut["p"] is None else F.coalesce(score > F.lit(cut["p"]), F.lit(False))
    return scored.withColumn("in_top", higher | (tied & first))


def fairness_audit(scored: DataFrame, groups: dict[str, str], id_col: str, y: str = "y", p: str = "p",
                   top_k_pct: float = fixed.FAIRNESS_TOP_K_PCT) -> DataFrame:
    """Four-fifths audit on the top ``top_k_pct`` by score, one row per group.

    ``groups`` maps a group name to a boolean SQL expression over the table.
    group_selection_rate is the positive rate among selected group members
    (the reference's definition); disparate_impact_ratio compares it with
    the positive rate of the whole selection (1 when that is 0). The
    standard selection rate (selected / group size) and its ratio to the
    overall selection rate are reported next to it.
    """
    flagged = top_k_flags(scored, top_k_pct, id_col, p)
    names = list(groups)
    arr = F.array(*[F.struct(F.lit(g).alias("group_name"), F.expr(groups[g]).alias("member")) for g in names])
    long = flagged.select(F.col(y).alias("__y"), "in_top", F.inline(arr)).filter("member")
    per = long.groupBy("group_name").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.count_if("in_top").alias("group_selected"),
        F.sum(F.when(F.col("in_top"), F.col("__y")).otherwise(0)).alias("__gpos"),
    )
    overall = flagged.agg(
        F.count(F.lit(1)).alias("__n"), F.count_if("in_top").alias("__sel"),
        F.sum(F.when(F.col("in_top"), F.col(y)).otherwise(0)).alias("__opos"),
    )
    ov = overall.select(F.struct(*overall.columns)).scalar()  # one-row aggregate as a scalar subquery
    j = per.select("*", *[ov[c].alias(c) for c in overall.columns])
    g_rate = F.when(F.col("group_selected") > 0, F.col("__gpos") / F.col("group_selected")).otherwise(F.lit(0.0))
    o_rate = F.when(F.col("__sel") > 0, F.col("__opos") / F.col("__sel")).otherwise(F.lit(0.0))
    ratio = F.when(o_rate > 0, g_rate / o_rate).otherwise(F.lit(1.0))
    sel_share = F.col("group_selected") / F.col("group_size")
    sel_overall = F.col("__sel") / F.col("__n")
    sel_ratio = F.when(sel_overall > 0, sel_share / sel_overall).otherwise(F.lit(1.0))
    return j.select(
        "group_name", "group_size", "group_selected",
        g_rate.alias("group_selection_rate"), o_rate.alias("overall_selection_rate"),
        ratio.alias("disparate_impact_ratio"), (ratio >= fixed.FOUR_FIFTHS).alias("passes_four_fifths_rule"),
        sel_share.alias("selection_share"), sel_ratio.alias("selection_share_ratio"),
    )


def score_summary(scored: DataFrame, by: str, p: str = "p") -> DataFrame:
    """min / max / mean score per product (or any grouping column)."""
    return scored.groupBy(by).agg(F.min(p).alias("min_score"), F.max(p).alias("max_score"),
                                  F.avg(p).alias("mean_score"), F.count(F.lit(1)).alias("n"))


def ks_curve_window(scored: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Reference-style cumulative curve via a plain window (small inputs only; tests)."""
    dist = score_distribution(scored, y, p)
    w = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return dist.select("p", F.sum("n_pos").over(w).alias("cum_pos"), F.sum("n_neg").over(w).alias("cum_neg"))
