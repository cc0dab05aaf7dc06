import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cauce import fixed
from cauce.operators import lifecycle

LOG = "batch_id string, ts int, event_id int, status string, state0 string"


def replay(rows):
    """One event after the other."""
    state, out = {}, []
    for b, t, e, s, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        now = state.get(b)
        ok = b is not None and (now is None and s == "queued" or (now, s) in fixed.STATUS_MOVES)
        verdict = ("unknown_status" if s not in fixed.BATCH_STATUSES else "accepted" if ok else "repeated" if now == s and b is not None
                   else "late" if now in ("completed", "failed") and b is not None else "illegal")
        out.append((e, now, verdict))
        if ok:
            state[b] = s
    return sorted(out), state


@pytest.mark.parametrize("seed", range(3))
def test_log_equals_replay(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.randrange(40), k, rng.choice(["queued", "processing", "completed", "failed", "paused", None]), "x") for k in range(120)]
    log = spark.createDataFrame(rows, LOG)
    want, state = replay(rows)
    out = lifecycle.checked_log(log)
    assert out.columns == [*log.columns, "state", "verdict"]
    assert sorted((r["event_id"], r["state"], r["verdict"]) for r in out.collect()) == want
    last = {r["batch_id"]: r["status"] for r in lifecycle.latest_states(log).collect()}
    assert {k: v for k, v in last.items() if v} == state and set(last) == {r[0] for r in rows} - {None}


def test_log_edges(spark):
    assert lifecycle.checked_log(spark.createDataFrame([], LOG)).count() == 0
    assert lifecycle.longest_chain(fixed.STATUS_MOVES) == 2
    with pytest.raises(ValueError):
        lifecycle.longest_chain([("a", "b"), ("b", "a")])


T0, T1, T2 = (dt.datetime(2024, 1, d) for d in (1, 2, 3))
MESSAGES = [(1, "b1", "scheduled", None), (2, "b1", "pending", None), (3, "b2", "sent", T0), (4, "b2", "scheduled", None), (5, "b3", "pending", None), (6, "b3", None, None)]
UPDATES = [(1, "b1", "scheduled", "pending", T1), (1, "b1", "scheduled", "pending", T1), (2, "b1", "scheduled", "pending", T1), (2, "b1", "pending", "sent", T2), (2, "b1", "pending", "sent", T1),
           (3, "b2", "sent", "scheduled", T1), (4, "b2", "scheduled", "sent", T1), (6, "b3", "scheduled", "pending", T1), (99, "b9", "scheduled", "pending", T1), (None, None, "scheduled", "pending", T1)]
AFTER = [(1, "pending", None), (2, "sent", T1), (3, "sent", T0), (4, "scheduled", None), (5, "pending", None), (6, None, None)]


def frames(spark):
    return (spark.createDataFrame(MESSAGES, "message_id long, batch_id string, status string, sent_at timestamp"),
            spark.createDataFrame(UPDATES, "message_id long, batch_id string, expected string, status string, at timestamp"))


def seen(df):
    return sorted((r["message_id"], r["status"], r["sent_at"]) for r in df.collect())


def test_compare_and_set(spark):
    messages, updates = frames(spark)
    once = lifecycle.compare_and_set(messages, updates.drop("batch_id"))
    assert once.columns == messages.columns and seen(once) == AFTER
    assert seen(lifecycle.compare_and_set(messages, updates.limit(0).drop("batch_id"))) == seen(messages)


def test_stored_updates_are_replay_safe(spark, tmp_path):
    messages, updates = frames(spark)
    path = f"{tmp_path}/outbox"
    messages.write.partitionBy("batch_id").parquet(path)
    # a writer that was lost after one partition, then the whole call, then again
    lifecycle.apply_updates(spark, path, updates.where("batch_id = 'b1'"))
    for _ in range(2):
        lifecycle.apply_updates(spark, path, updates)
        stored = spark.read.parquet(path)
        # the replay's pending rows move on only if an update expects that
        assert seen(stored.where("batch_id <> 'b1' or message_id = 2")) == [r for r in AFTER if r[0] != 1]
        assert {r["message_id"]: r["status"] for r in stored.collect()}[1] == "pending"
    untouched = {f.name for f in (tmp_path / "outbox" / "batch_id=b3").iterdir()}
    lifecycle.apply_updates(spark, path, updates.where("batch_id = 'b2'"))
    assert {f.name for f in (tmp_path / "outbox" / "batch_id=b3").iterdir()} == untouched


def test_governed(spark):
    day = lambda n: dt.date(2024, 1, 31) - dt.timedelta(days=n)
    rows = [("contract", True, day(10), 10, "active"), ("contract", True, day(11), 10, "stale"), ("contract", True, day(0), 0, "active"), ("contract", True, day(-1), 10, "not_yet"),
            ("contract", False, day(0), 10, "no_consent"), ("contract", None, day(0), 10, "no_consent"), (" UNKNOWN", True, day(0), 10, "no_legal_basis"), (None, None, None, None, "no_legal_basis"),
            ("contract", True, None, 10, "stale"), ("contract", True, day(1), None, "stale")]
    values = spark.createDataFrame(rows, "legal_basis string, consent boolean, observed date, ttl_days int, want string")
    assert all(r["governance"] == r["want"] for r in lifecycle.governed(values, F.lit("2024-01-31").cast("date")).collect())
