"""Windowed rates against a replay by hand; the top share against a full sort."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cauce.operators.metrics import top_k_flags
from cauce.streaming import jobs


@pytest.mark.parametrize("pct", [0.0, 0.1, 0.5, 0.83, 1.0])
def test_top_share_with_ties_nulls_and_nan(spark, pct):
    rng = random.Random(9)
    rows = [(i, rng.choice([0.1, 0.5, 0.5, 0.5, 0.9, None, float("nan"), rng.random()]), "x") for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, p double, in_top_before string").repartition(5)
    best = sorted(rows, key=lambda r: (r[1] is None, -(9.0 if r[1] is not None and r[1] != r[1] else r[1] or 0.0), r[0]))
    got = top_k_flags(frame, pct, "id")
    assert {r["id"] for r in got.filter("in_top").collect()} == {r[0] for r in best[:int(400 * pct)]}
    assert got.count() == 400 and top_k_flags(frame.limit(0), pct, "id").count() == 0


def test_rows_behind_the_watermark_are_dropped_and_a_replay_changes_nothing(spark, tmp_path):
    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    files = [[(1, day(1), 1, "purchase"), (2, day(1), 2, "view"), (6, day(2), 1, "view")],
             [(12, day(1, 5), 1, "purchase"), (18, day(9), 1, "purchase"), (24, day(9), 99, "view")],  # day 1 is still open; 99 is no member
             [(30, day(1, 6), 1, "purchase"), (36, day(9, 3), 1, "view")],  # day 1 is closed by day 9
             [(42, day(10), 3, "view")]]
    source, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    members = spark.createDataFrame([(str(100000000 + i), 80.0 if i == 1 else 10.0, "A") for i in (1, 2, 3)], "member_id string, digital_affinity double, category string")

    def drain(checkpoint):
        jobs.channel_window_stream(spark, source, out, checkpoint=checkpoint, members=members, file_glob="*.parquet").awaitTermination()

    for i, rows in enumerate(files):
        frame = spark.createDataFrame([(e, t, u, k, 0.0, "") for e, t, u, k in rows], jobs.INTERACTION_SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(source)
        drain(ck)
    state = jobs.window_state(spark, out)
    seen = sorted((str(r["window_start"])[:10], r["segment"], r["channel"], r["sends"], r["accepts"]) for r in state.collect())
    assert seen == [("2024-01-01", "high|A", "sms", 1, 1), ("2024-01-01", "high|A", "whatsapp", 1, 1), ("2024-01-01", "low|A", "email", 1, 0),
                    ("2024-01-02", "high|A", "whatsapp", 1, 0), ("2024-01-09", "high|A", "whatsapp", 2, 1), ("2024-01-10", "low|A", "whatsapp", 1, 0)]
    drain(ck)
    assert jobs.window_state(spark, out).exceptAll(state).count() == 0
    prior = 3 / 7
    rate = jobs.window_rates(state).filter(F.col("sends") == 2).first()["rate"]
    assert abs(rate - (1 + 50 * prior) / 52) < 1e-12
