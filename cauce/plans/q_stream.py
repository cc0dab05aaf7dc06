"""Streaming queries whose final state is compared with a batch SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cauce.plans.oracle import cte, sql
from cauce.plans.registry import register
from cauce.session import shared_path
from cauce.sources import derived
from cauce.streaming import jobs

cte("segment_windows", """
SELECT date_trunc('day', contacted_at) AS window_start, segment, channel, CAST(count(*) AS BIGINT) AS sends, CAST(count(*) FILTER (WHERE outcome = 'accepted') AS BIGINT) AS accepts
FROM segmented GROUP BY ALL""", ["segmented"])

@register("stream_channel_windows", "X-05, A-20", sql("""
SELECT date_trunc('day', ts) AS window_start,
       CASE event_id % 6 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'sms' WHEN 2 THEN 'email' WHEN 3 THEN 'app'
                         WHEN 4 THEN 'callcenter' ELSE 'branch' END AS channel,
       CAST(count(*) AS BIGINT) AS sends, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS accepts
FROM events GROUP BY 1, 2"""))
def stream_channel_windows(spark, sf_dir):
    """Runs the interaction stream to completion (availableNow) and reads its sink."""
    run = shared_path(spark, f"x05-{uuid.uuid4().hex}")
    out = f"{run}/out"
    q = jobs.channel_window_stream(spark, sf_dir, out, checkpoint=f"{run}/ckpt")
    q.awaitTermination()
    return jobs.window_state(spark, out)


@register("stream_segment_rates", "X-05, A-20, W-14", sql("""
SELECT window_start, segment, channel, sends, accepts, round((accepts + 50 * (SELECT sum(accepts) / CAST(sum(sends) AS DOUBLE) FROM segment_windows)) / (sends + 50), 10) AS rate
FROM segment_windows""", "segment_windows"))
def stream_segment_rates(spark, sf_dir):
    """Rolling rates by day, segment and channel: the stream joined to the members, its final state and rates."""
    run = shared_path(spark, f"x05-{uuid.uuid4().hex}")
    q = jobs.channel_window_stream(spark, sf_dir, f"{run}/out", checkpoint=f"{run}/ckpt", members=derived.member_features(spark, sf_dir))
    q.awaitTermination()
    return jobs.window_rates(jobs.window_state(spark, f"{run}/out")).withColumn("rate", F.round("rate", 10))
