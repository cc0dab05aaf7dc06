"""Status logs, guarded message updates and governed values, over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cauce.operators import lifecycle
from cauce.plans.oracle import cte, sql
from cauce.plans.registry import register
from cauce.sources.tables import read_table

cte("status_log", """
SELECT event_id, user_id AS batch_id, ts,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'archived' END AS status
FROM events""")
cte("log_queued", "SELECT batch_id, min((ts, event_id)) AS q FROM status_log WHERE status = 'queued' GROUP BY batch_id", ["status_log"])
cte("log_started", """SELECT l.batch_id, min((l.ts, l.event_id)) AS p FROM status_log l JOIN log_queued s ON l.batch_id = s.batch_id
WHERE l.status = 'processing' AND (l.ts, l.event_id) > s.q GROUP BY l.batch_id""", ["status_log", "log_queued"])
cte("log_ended", """SELECT batch_id, e, CASE WHEN status = 'completed' THEN 'completed' ELSE 'failed' END AS how FROM (
  SELECT l.batch_id, (l.ts, l.event_id) AS e, l.status, row_number() OVER (PARTITION BY l.batch_id ORDER BY l.ts, l.event_id) AS k
  FROM status_log l JOIN log_started s ON l.batch_id = s.batch_id WHERE l.status IN ('completed', 'failed') AND (l.ts, l.event_id) > s.p) x WHERE k = 1""", ["status_log", "log_started"])


def status_log(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for x in ("signup", "queued", "click", "processing", "purchase", "completed", "error", "failed")])
    return read_table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("batch_id"), "ts", F.coalesce(F.try_element_at(status, F.col("event_type")), F.lit("archived")).alias("status"))


@register("lifecycle_log", "W-09", sql("""
SELECT event_id, batch_id, ts, status, state,
       CASE WHEN status = 'archived' THEN 'unknown_status' WHEN coalesce(o = q AND status = 'queued' OR o = p OR o = e, false) THEN 'accepted' WHEN state = status THEN 'repeated'
            WHEN state IN ('completed', 'failed') THEN 'late' ELSE 'illegal' END AS verdict
FROM (SELECT l.*, (l.ts, l.event_id) AS o, a.q, b.p, c.e,
             CASE WHEN (l.ts, l.event_id) > c.e THEN c.how WHEN (l.ts, l.event_id) > b.p THEN 'processing' WHEN (l.ts, l.event_id) > a.q THEN 'queued' END AS state
      FROM status_log l LEFT JOIN log_queued a ON l.batch_id = a.batch_id LEFT JOIN log_started b ON l.batch_id = b.batch_id LEFT JOIN log_ended c ON l.batch_id = c.batch_id) x""",
    "status_log", "log_queued", "log_started", "log_ended"))
def lifecycle_log(spark, sf_dir):
    """Every event of the log with the state it met and its verdict."""
    return lifecycle.checked_log(status_log(spark, sf_dir))


@register("lifecycle_states", "W-09", sql("""
SELECT l.batch_id, CASE WHEN c.how IS NOT NULL THEN c.how WHEN b.p IS NOT NULL THEN 'processing' WHEN a.q IS NOT NULL THEN 'queued' END AS status,
       CAST((a.q IS NOT NULL)::INT + (b.p IS NOT NULL)::INT + (c.e IS NOT NULL)::INT AS BIGINT) AS moves
FROM (SELECT DISTINCT batch_id FROM status_log WHERE batch_id IS NOT NULL) l LEFT JOIN log_queued a ON l.batch_id = a.batch_id
LEFT JOIN log_started b ON l.batch_id = b.batch_id LEFT JOIN log_ended c ON l.batch_id = c.batch_id""", "status_log", "log_queued", "log_started", "log_ended"))
def lifecycle_states(spark, sf_dir):
    return lifecycle.latest_states(status_log(spark, sf_dir))


@register("message_moves", "Q-05", sql("""
SELECT event_id AS message_id,
       CASE WHEN s = 0 AND event_id % 2 = 0 THEN 'pending' WHEN s = 1 AND event_id % 5 = 0 THEN 'sent' ELSE ['scheduled', 'pending', 'sent'][s + 1] END AS status,
       CASE WHEN s = 1 AND event_id % 5 = 0 THEN ts + INTERVAL 1 HOUR WHEN s = 2 THEN ts END AS sent_at
FROM (SELECT event_id, ts, CAST(event_id % 3 AS INTEGER) AS s FROM events) x"""))
def message_moves(spark, sf_dir):
    """Updates that hold, that find another status, that are not allowed and that name no message."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts")
    status = F.element_at(F.array(*map(F.lit, ("scheduled", "pending", "sent"))), (F.col("event_id") % 3 + 1).cast("int"))
    messages = e.select(F.col("event_id").alias("message_id"), status.alias("status"), F.when(F.col("event_id") % 3 == 2, F.col("ts")).alias("sent_at"))
    hour = F.expr("INTERVAL 1 HOUR")
    every = lambda n, a, b, shift: e.where(F.col("event_id") % n == 0).select((F.col("event_id") + shift).alias("message_id"), F.lit(a).alias("expected"), F.lit(b).alias("status"), (F.col("ts") + hour).alias("at"))
    updates = every(2, "scheduled", "pending", 0).unionByName(every(5, "pending", "sent", 0)).unionByName(every(7, "sent", "scheduled", 0)).unionByName(every(3, "scheduled", "pending", 1 << 40))
    return lifecycle.compare_and_set(messages, updates)


@register("governed_values", "V-17", sql("""
SELECT source, governance, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT source, CASE WHEN event_id % 7 = 0 OR event_id % 7 = 1 THEN 'no_legal_basis' WHEN event_id % 5 = 0 THEN 'no_consent' WHEN age < 0 THEN 'not_yet' WHEN age <= ttl THEN 'active' ELSE 'stale' END AS governance
  FROM (SELECT event_id, event_type AS source, event_id % 90 AS ttl, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS age FROM events) x) y
GROUP BY source, governance"""))
def governed_values(spark, sf_dir):
    """Values by source and state on 1 February 2024; a value is active on its last day."""
    k = F.col("event_id")
    e = read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("member_id"), F.col("event_type").alias("source"), F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "Unknown ").otherwise("contract").alias("legal_basis"),
        (k % 5 != 0).alias("consent"), F.to_date("ts").alias("observed"), (k % 90).cast("int").alias("ttl_days"))
    return lifecycle.governed(e, F.lit("2024-02-01").cast("date")).groupBy("source", "governance").agg(F.count(F.lit(1)).alias("n"))
