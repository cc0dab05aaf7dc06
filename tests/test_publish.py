"""Several tables change together or not at all."""

import pytest

from cauce.sources import publish


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_bulk_load_is_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "a store")
    first = spark.createDataFrame([("1", "a"), ("2", "b")], "cedula string, nombre string")
    assert publish.current(spark, root) == (0, {})
    assert publish.bulk_load(spark, root, first) == 2
    assert publish.bulk_load(spark, root, spark.createDataFrame([("3", None)], first.schema)) == 1
    for bad in ([("4", "x"), ("4", "y")], [("5", "x"), ("2", "y")], [("6", "x"), (None, "y")]):
        with pytest.raises(ValueError):
            publish.bulk_load(spark, root, spark.createDataFrame(bad, first.schema))
    assert _rows(publish.read(spark, root, "persons").fillna("")) == [("1", "a"), ("2", "b"), ("3", "")]
    assert publish.bulk_load(spark, root, first.limit(0)) == 0


def test_replace_clears_the_outbox_and_a_failure_keeps_the_old_state(spark, tmp_path):
    root = str(tmp_path / "s")
    persons = spark.createDataFrame([("1",), ("2",)], "cedula string")
    outbox = spark.createDataFrame([(7, "1")], "message_id long, cedula string")
    publish.publish(spark, root, replace={"persons": persons, "scheduled_messages": outbox})
    from pyspark.sql import functions as F
    broken = persons.select(F.raise_error(F.lit("lost")).cast("string").alias("cedula"))
    with pytest.raises(Exception, match="lost"):  # the first table is written, the second fails
        publish.publish(spark, root, replace={"scheduled_messages": outbox.limit(0), "persons": broken})
    assert publish.current(spark, root)[0] == 1
    assert _rows(publish.read(spark, root, "persons")) == [("1",), ("2",)] and publish.read(spark, root, "scheduled_messages").count() == 1
    before = publish.read(spark, root, "persons")
    assert publish.replace_dataset(spark, root, spark.createDataFrame([("9",)], "cedula string")) == 2
    assert _rows(publish.read(spark, root, "persons")) == [("9",)] and publish.read(spark, root, "scheduled_messages").count() == 0
    assert _rows(before) == [("1",), ("2",)]  # a reader that began earlier keeps its state


def test_two_writers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    one = spark.createDataFrame([("1",)], "cedula string")
    publish.publish(spark, root, replace={"persons": one})
    with pytest.raises(publish.Conflict):
        publish.publish(spark, root, replace={"persons": one}, base=0)
    real = publish.current
    monkeypatch.setattr(publish, "current", lambda s, r: (0, {}))  # a writer that has not seen state 1
    with pytest.raises(publish.Conflict):
        publish.publish(spark, root, replace={"persons": one.limit(0)})
    monkeypatch.setattr(publish, "current", real)
    assert _rows(publish.read(spark, root, "persons")) == [("1",)]


def test_deleted_batches_take_their_rows(spark, tmp_path):
    root = str(tmp_path / "s")
    batches = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "batch_id string, n int")
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b"), ("4", None)], "person_id string, batch_id string")
    publish.publish(spark, root, replace={"batches": batches, "batch_persons": rows})
    publish.delete_batches(spark, root, spark.createDataFrame([("b",), ("b",), ("z",), (None,)], "batch_id string"))
    assert _rows(publish.read(spark, root, "batches")) == [("a", 1), ("c", 3)]
    assert _rows(publish.read(spark, root, "batch_persons").fillna("")) == [("1", "a"), ("4", "")]
